"""The isolation forest against a plain walk, and what it judges that single limits can't."""

from __future__ import annotations

import zlib

import numpy as np

from pyspark.sql import functions as F

from tidemark.llm import quality


def plain_path(forest, t: int, row: np.ndarray) -> float:
    node = 0
    while forest.feature[t, node] >= 0:
        node = 2 * node + (2 if row[forest.feature[t, node]] > forest.split[t, node] else 1)
    return forest.length[t, node]


def plain_grown(forest, t: int, x: np.ndarray, rows: np.ndarray, node: int = 0, level: int = 0) -> None:
    """Every node's length is its level and the expected depth of the rows that fall there."""
    assert abs(forest.length[t, node] - level - float(quality.mean_depth(len(rows)))) < 1e-9
    f = forest.feature[t, node]
    if f >= 0:
        assert len(rows) > 1 and level < forest.depth
        left = x[rows, f] <= forest.split[t, node]
        plain_grown(forest, t, x, rows[left], 2 * node + 1, level + 1)
        plain_grown(forest, t, x, rows[~left], 2 * node + 2, level + 1)


def test_paths_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    low, high = np.full(4, -5.0), np.full(4, 5.0)
    forest = quality.IsolationForest(20, 64).fit(x, low, high)  # all rows in every tree
    for t in range(20):
        plain_grown(forest, t, x, np.arange(60))
    asked = np.concatenate([x, rng.uniform(-6, 6, (40, 4))])
    want = [2 ** -(np.mean([plain_path(forest, t, r) for t in range(20)]) / float(quality.mean_depth(60))) for r in asked]
    assert np.allclose(forest.score(asked), want)
    assert np.median(forest.score(asked[60:])) > np.quantile(forest.score(x), 0.9)


def test_limit_equals_all_limits_tried():
    rng = np.random.default_rng(2)
    for n in (5, 40):
        scores, good = rng.normal(size=n).round(1), rng.random(n) < 0.7
        good[0], good[1] = True, False
        limit = quality.calibrate(scores, good, 0.2)

        def gain(at):
            lost, caught = (scores[good] > at).mean(), (scores[~good] > at).mean()
            return caught - lost if lost <= 0.2 else -1

        assert gain(limit) == max(map(gain, [*scores, *(scores - 0.01)]))
    assert quality.calibrate(scores, np.ones(n, bool), 0.1) == np.inf


def test_forest_judges_together_what_no_single_limit_shows(spark):
    """Good texts have either many symbols or long words; a text with both is bad, though within each limit."""
    rng = np.random.default_rng(3)

    def text(long_words: bool, symbols: bool) -> str:
        size, every = (int(rng.integers(8, 13)) if long_words else 1), int(rng.integers(3, 6))
        words = [f"{'w' * size}{k}{'%' if symbols and k % every == 0 else ''}" for k in rng.integers(1000, 9999, 90)]
        return " ".join(words)

    kinds = [(True, False), (False, True), (False, False)] * 200
    rows = [(i, text(*k)) for i, k in enumerate(kinds)] + [(1000 + i, text(True, True)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = [(i, int(i < 1000)) for i, _ in rows if zlib.crc32(str(i).encode()) % 2]
    judged = quality.isolate(docs, spark.createDataFrame(labelled, "doc_id long, quality int")).toPandas()
    x = quality.features(judged)
    good = judged.doc_id.to_numpy() < 1000
    kept, held_out = judged.kept.to_numpy(), ~judged.doc_id.isin([i for i, _ in labelled]).to_numpy()
    limits = (x[good].min(0), x[good].max(0))
    by_limits = ((x >= limits[0]) & (x <= limits[1])).all(1)
    assert by_limits[~good & held_out].mean() > 0.5  # plain limits let them pass
    assert kept[good & held_out].mean() >= 0.97 and kept[~good & held_out].mean() <= 0.05


def test_held_out_documents(spark):
    """On the driver's documents, with the labels of odd ids alone: held-out recall and loss."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.isolate(docs, labels.where("doc_id % 2 = 1")).join(labels.where("doc_id % 2 = 0"), "doc_id").where("not base_failed").toPandas()
    good = judged.quality.to_numpy() == 1
    assert judged.kept[good].mean() >= 0.98 and judged.kept[~good].mean() <= 0.05


def test_limit_counts_all_rows(spark):
    """The distributed limit is calibrate()'s, and one label in many, which a bound on rows would pass over, moves it."""
    rng = np.random.default_rng(6)
    for n in (5, 400):
        scores, good = rng.normal(size=n).round(2), rng.random(n) < 0.7
        good[0], good[1] = True, False
        rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean").repartition(3)
        for lost in (0.0, 0.05, 0.2):
            assert quality.calibrated(rows, lost) == quality.calibrate(scores, good, lost)
    assert quality.calibrated(rows.where("good"), 0.1) == quality.calibrated(rows.limit(0), 0.1) == np.inf


def test_no_document_is_outside_the_range(spark, monkeypatch):
    """Of 30,000 documents one has symbols: the root cell holds it, as it comes from all rows."""
    cells: list[tuple] = []
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 52), k -> concat('w', k + id % 7)), ' ')").alias("text"))
    odd = spark.createDataFrame([(30_000 + i, "% " * (i == 0) + " ".join(f"v{k}" for k in range(60))) for i in range(2)], "doc_id long, text string")
    real = quality.IsolationForest.fit

    def fit(self, x, low, high, *more):
        cells.append((low, high))
        return real(self, x, low, high, *more)

    monkeypatch.setattr(quality.IsolationForest, "fit", fit)
    for seed in (1, 2, 3):
        judged = quality.isolate(docs.unionByName(odd), spark.createDataFrame([(0, 1)], "doc_id long, quality int"), seed=seed)
        assert judged.columns[-1] == "kept"
    assert all(high[1] > np.log1p(100 / 61) > low[1] for low, high in cells)
