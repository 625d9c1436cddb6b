"""The plan of batch search: blocks meet without a key, over many tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def vectors(spark, n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dims[i % len(dims)])]) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)


def test_blocks_of_all_dimensions_spread_over_tasks(spark, no_broadcast, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 4096)
    index = vectors(spark, 400, (8, 8, 8, 5), 1)
    asked = vectors(spark, 60, (8, 5), 2).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = search.knn_l2_batch(index, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dim" not in "".join(line for line in plan.splitlines() if "Join" in line and "Cartesian" not in line) and "hashpartitioning(dim" not in plan
    assert "CartesianProduct" in plan
    x = {r.chunk_id: np.array(r.embedding, float) for r in index.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.ord, r.chunk_id))
    for r in asked.collect():
        q = np.array(r.query_vector, float)
        want = sorted((((v - q) ** 2).sum(), i) for i, v in x.items() if len(v) == len(q))[:3]
        assert [i for _, i in sorted(got[r.query_id])] == [i for _, i in want]
    met = search._blocks(index.select(F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    other = met.select([F.col(c).alias(f"q_{c}") for c in met.columns])
    tasks = met.crossJoin(other).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 12 and max(r["count"] for r in tasks) < 0.2 * sum(r["count"] for r in tasks)


def test_ties_are_ties_to_the_last_bit(spark):
    """Distances add up as SQL adds; equal words in another order score the same, wherever they lie and however questions come."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 64))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    asked = vectors.limit(5).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for r in search.knn_l2_batch(vectors, asked, 10).collect():
        total = 0.0
        for a, b in zip(x[r.chunk_id], x[r.query_id]):
            total += (a - b) * (a - b)
        assert r.distance == total

    rows = []
    for i in range(30):
        words = [f"w{k}" for k in rng.integers(0, 40, 30)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[::-1]))]
    questions = [(i, " ".join(f"w{k}" for k in rng.permutation(40)[:25])) for i in range(20)]
    seen = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "chunk_id long, content string").repartition(parts)
        some = spark.createDataFrame(questions, "query_id long, question string").repartition(parts)
        score = {(r.query_id, r.chunk_id): r.score for r in search.bm25(docs, some, 60).collect()}
        assert len(score) == 1200 and all(score[q, d] == score[q, d ^ 1] for q, d in score)
        seen.append(score)
    assert seen[0] == seen[1]
