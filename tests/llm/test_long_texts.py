"""Texts of a megabyte that strain matchers, through the operators and the pipeline's stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, packing, phrases, quality, sharding, simhash, suffixes, surrogates, token_counts, toxicity

MB = 1_000_000
TEXTS = {
    1: "\n" * MB, 2: " " * MB, 3: "a@" + "a." * (MB // 2) + "com", 4: "1 " * (MB // 2), 5: "A" * MB, 6: "7" * MB, 7: "Mr " + "A" * MB, 8: "a-" * (MB // 2),
    9: "DE89 " + "0044 " * (MB // 5), 10: "ab:" * (MB // 3), 11: "-----BEGIN PRIVATE KEY-----\n" + "Ab3/" * (MB // 4) + "\n-----END PRIVATE KEY-----", 12: "a@" + "a" * MB + ".com",
    13: "password: " + "x" * MB, 14: " \n\t" * (MB // 3), 20: "plain text of a few words", 21: "mail ann.lee@mail.example.com now",
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(20, 1, 0), (21, 0, 1), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def test_ids_equal_the_tokenizer():
    encoder = bpe.load(bpe.default_path())
    for text in TEXTS.values():
        assert encoder.encode(text) == encoder._pack(encoder.whole.encode(text, add_special_tokens=False).ids)


def test_private_data(long_docs):
    got = {r.doc_id: r.text for r in surrogates.replace_private(long_docs).collect()}
    assert set(got) == set(TEXTS) and got[20] == TEXTS[20] and "ann.lee" not in got[21]
    assert "Ab3/" * 5 not in got[11] and "x" * 7 not in got[13]


def test_other_operators(spark, long_docs, labels):
    n = len(TEXTS)
    assert toxicity.toxicity(long_docs, labels).count() == n
    assert quality.isolate(long_docs, labels).count() == n
    assert simhash.near_classes(long_docs).count() == n
    assert token_counts.count_tokens(long_docs, fields=("source", "text")).agg(F.sum("n_tokens")).first()[0] > MB
    assert suffixes.drop_repeats(long_docs, digest=True).count() == n
    assert packing.pack_powers(long_docs).groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b")).where("a = b").count() == n
    assert sharding.shard_documents(long_docs).count() == n
    assert phrases.collocations(long_docs).count() >= 0


def test_stages(spark, long_docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = long_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() > 100
