"""The corpus pipeline: raw documents to packed training sequences, stage by stage.

Each stage takes all rows that the one before it kept. All but the last return
the columns of documents; run() writes each stage's rows to the shared folder
and reads them again, so a lost executor costs at most one stage.

Every stage takes nulls in any column, empty texts, repeated rows, other columns
and empty tables: null and empty texts are never toxic (where both labels
occur), count as copies of each other, hold nothing private, are mixed with size
0 and packed as the end token alone. Repeated rows leave one in near-dedup. A
null source is a source. No rows in: no rows out.

As part of tidemark.llm it is removable together with that subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, packing, surrogates, toxicity
from tidemark.llm.common import scratch, shared_dir, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents it rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, and what it misses: of documents linked by a similarity of 0.8 or more over five-word shingles that of the smallest id stays."""
    return jaccard.keep_one(docs, shingle=5, similarity=0.8)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: surrogates in the text, and n_chars to match."""
    return surrogates.replace_private(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: every document as often as its source's rate says."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two packing; a document that the mix repeats is packed each time."""
    packed = packing.pack_powers(docs)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


STAGES = [
    ("toxicity", clean),
    ("simhash_near_dedup", dedupe),
    ("private_data", protect),
    ("mix_sources", mix),
    ("pack", pack),
]

#: SQL can't express the trained classifier or the tokenizer; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Of the tables written on the way only each stage's own result stays."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(made)
        docs = spark.read.schema(out.schema).parquet(made)
    return STAGES[-1][1](spark, docs, sf_dir)
