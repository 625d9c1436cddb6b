"""The stored keyword index against the search that tokenizes at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rag, search
from tidemark.providers import GenAIChatClient, GenAIEmbeddingClient
from tidemark.sources import index, keywords


def zipf(rng, n, kinds=3000):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % kinds}" for _ in range(n))


@pytest.mark.parametrize("block, seed", [(8, 10), (64, 1000)])
def test_same_texts_scores_and_order(spark, tmp_path, monkeypatch, block, seed):
    monkeypatch.setattr(keywords, "BLOCK", block)
    monkeypatch.setattr(keywords, "SEED", seed)
    rng = random.Random(6)
    rows = [(i, zipf(rng, rng.randint(1, 80), 200)) for i in range(600)] + [(900, None), (901, ""), (902, "w1 " * 500), (-3, "W1, w2!"), (903, "w1"), (904, "w1")]
    docs = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    asked = [(i, zipf(rng, rng.randint(1, 12), 200)) for i in range(40)] + [(100, "unknown words"), (101, None), (102, "w1"), (103, "w1 w1 w2"), (104, "")]
    questions = spark.createDataFrame(asked, "query_id long, question string")
    keywords.build(docs, str(tmp_path), "chunk_id", "content")
    for k in (1, 4):
        got, work = keywords.search(spark, str(tmp_path), questions, k)
        want = search.bm25(docs, questions, k)
        key = lambda r: (r[0], r[3])
        got, want = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
        assert [(q, i, o) for q, i, _, o in got] == [(q, i, o) for q, i, _, o in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))
        assert {r.query_id for r in work.collect()} == {i for i, t in asked if t and "w" in t} - {100}


def test_common_terms_are_mostly_skipped(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"a b c d e {zipf(rng, 10)} x{i % 997}") for i in range(20_000)]
    rows = [(i, t + " e" * rng.randint(0, 1)) for i, t in rows]
    docs = spark.createDataFrame(rows, "chunk_id long, content string")
    questions = spark.createDataFrame([(i, f"a b c d e x{i}") for i in range(20)], "query_id long, question string")
    keywords.build(docs, str(tmp_path), "chunk_id", "content")
    got, work = keywords.search(spark, str(tmp_path), questions, 3)
    assert work.agg(F.sum("read") / F.sum("postings")).first()[0] < 0.3
    want = search.bm25(docs, questions, 3)
    assert {(r.query_id, r.id, r.ord) for r in got.collect()} == {(r.query_id, r.chunk_id, r.ord) for r in want.collect()}


def test_empty_index_and_hybrid_answers(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, content string")
    keywords.build(none, f"{tmp_path}/none")
    questions = spark.createDataFrame([(0, "tide"), (1, "moon")], "query_id long, question string")
    assert keywords.search(spark, f"{tmp_path}/none", questions)[0].count() == 0
    embed = GenAIEmbeddingClient("hash")
    docs = spark.createDataFrame([(0, "the moon pulls. " * 8), (1, "a tide turns. " * 8)], "doc_seq long, content string")
    path, chunks = index.VectorEmbedding(embed, 60, 5).generate_index(docs, "content", f"{tmp_path}/ix")
    keywords.build(chunks, f"{tmp_path}/kw")
    answers = []
    for client in (rag.Bm25Client(), rag.Bm25Client(f"{tmp_path}/kw")):
        inferencer = rag.RAGInferencer(embed, GenAIChatClient("stub"), client)
        answers.append(sorted(map(tuple, inferencer.infer_frame(questions, mode="hybrid", index_path=path, top_k=2).collect())))
    assert answers[0] == answers[1] and len(answers[0]) == 2
