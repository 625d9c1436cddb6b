"""The stored vector index against the scan: the same rows, fewer vectors read where they lie in clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.sources import rings


def frames(spark, x, q):
    index = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(10**6, None)], "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)] + [(10**6, None), (10**6 + 1, [1.0])], "query_id long, query_vector array<float>")
    return index, asked


def rows(frame):
    return sorted((r.query_id, r.ord, r.chunk_id, round(r.distance, 6)) for r in frame.collect())


@pytest.mark.parametrize("clusters, share", [(40, 0.3), (0, 1.0001)])
def test_same_rows_as_the_scan(spark, tmp_path, monkeypatch, clusters, share):
    monkeypatch.setattr(rings, "RING_BYTES", 2048)
    rng = np.random.default_rng(clusters)
    centre = rng.normal(size=(max(clusters, 1), 8)) * 10 * (clusters > 0)
    x, q = (centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, 8)) for n in (4000, 50))
    x[100:110] = x[0]  # ties
    q[0] = x[0]
    index, asked = frames(spark, x, q)
    rings.build(index, str(tmp_path), pivots=64)
    for k in (1, 6):
        found, work = rings.search(spark, str(tmp_path), asked, k)
        assert rows(found) == rows(search.knn_l2_batch(index, asked, k))
        read = work.agg(F.sum("read") / F.sum("vectors"), F.count("*")).first()
        assert read[0] < share and read[1] == 50


def test_few_vectors_and_none(spark, tmp_path):
    index, asked = frames(spark, np.eye(3), np.ones((2, 3)))
    rings.build(index, f"{tmp_path}/few")
    found, _ = rings.search(spark, f"{tmp_path}/few", asked, 5)
    assert [(q, o, i) for q, o, i, _ in rows(found)] == [(q, i + 1, i) for q in (0, 1) for i in range(3)]
    rings.build(index.limit(0), f"{tmp_path}/none")
    assert rings.search(spark, f"{tmp_path}/none", asked, 2)[0].count() == 0
    with pytest.raises(ValueError):
        rings.build(asked.select(F.col("query_id").alias("chunk_id"), F.col("query_vector").alias("embedding")), f"{tmp_path}/odd")
