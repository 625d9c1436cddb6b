"""Managed indexes: what upserts write, what readers see, and what is left when one breaks off."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.session import list_paths
from tidemark.sources import managed

SCHEMA = "id long, content string, embedding array<float>"


@pytest.fixture
def name(spark):
    made = f"tide_{uuid.uuid4().hex}"
    yield made
    managed.drop(spark, made)


def rows(spark, ids, said):
    return spark.createDataFrame([(i, f"{said} {i}", [float(i), 0.5]) for i in ids], SCHEMA)


def held(spark, name):
    got = {r.id: r.content for r in spark.table(name).collect()}
    assert spark.table(name).count() == len(got)
    return got


def test_any_upserts_equal_a_rewrite(spark, name, monkeypatch):
    monkeypatch.setattr(managed, "RANGE_ROWS", 60)
    monkeypatch.setattr(managed, "MERGE_SHARE", 0.3)
    rng, want, merges, most = random.Random(4), {}, 0, 0
    for turn in range(11):
        some = range(0, 300) if turn == 0 else rng.sample(range(-50, 400), rng.choice([0, 1, 5, 12, 40]))
        managed.upsert(spark, name, rows(spark, some, turn))
        want |= {i: f"{turn} {i}" for i in some}
        assert held(spark, name) == want
        now = managed.state(spark, name)
        merges, most = merges + (not now["deltas"]), max(most, len(now["deltas"]))
        lows = [low for low, *_ in now["base"]]
        assert lows == sorted(set(lows)) and lows[0] == managed.LOWEST
    assert merges > 1 and 0 < most <= 6 and len(lows) > 3
    assert len(list_paths(spark, managed._root(spark, name))) < 25


def test_a_small_upsert_writes_little(spark, name):
    big = spark.range(200_000).select("id", F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("content"), F.array(F.rand(1), F.rand(2)).cast("array<float>").alias("embedding"))
    managed.upsert(spark, name, big)
    before = managed.state(spark, name)
    size = lambda folders: sum(len(r.content) for f in folders for r in spark.read.format("binaryFile").load(f).collect())
    base = size(f for _, f, _ in before["base"])
    for turn in range(3):
        managed.upsert(spark, name, rows(spark, range(turn, 200_000, 1000), "new"))
        now = managed.state(spark, name)
        assert now["base"] == before["base"] and size(f for f, _ in now["deltas"]) < 0.01 * base
    assert spark.table(name).where("content like 'new%'").count() == 600 and spark.table(name).count() == 200_000
    plan = spark.table(name)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_only_touched_ranges_are_written_anew(spark, name, monkeypatch):
    monkeypatch.setattr(managed, "RANGE_ROWS", 100)
    managed.upsert(spark, name, rows(spark, range(1000), "old"))
    before = managed.state(spark, name)["base"]
    managed.upsert(spark, name, rows(spark, range(0, 150), "new"))
    after = managed.state(spark, name)
    assert not after["deltas"] and len(before) >= 9
    same = {f for _, f, _ in before} & {f for _, f, _ in after["base"]}
    assert len(same) >= len(before) - 3 and sum(n for *_, n in after["base"]) == 1000
    assert held(spark, name) == {i: f"{'new' if i < 150 else 'old'} {i}" for i in range(1000)}


@pytest.mark.parametrize("share", [0.0, 9.0])
def test_a_broken_upsert_leaves_the_old_state(spark, name, monkeypatch, share):
    managed.upsert(spark, name, rows(spark, range(20), "a"))
    managed.upsert(spark, name, rows(spark, [1], "b"))
    want = held(spark, name)
    with monkeypatch.context() as m:
        m.setattr(managed, "MERGE_SHARE", share)
        for step in ("_write", "_newest", "_merge", "_select"):
            with monkeypatch.context() as broken:
                broken.setattr(managed, step, lambda *_: 1 / 0)
                try:
                    managed.upsert(spark, name, rows(spark, [1, 2], "c"))
                except ZeroDivisionError:
                    assert held(spark, name) == want
                else:  # a step that this upsert doesn't take
                    want |= {i: f"c {i}" for i in (1, 2)}
        managed.upsert(spark, name, rows(spark, [3], "d"))
    assert held(spark, name) == want | {3: "d 3"}


def test_edges(spark, name):
    assert managed.state(spark, name) is None
    managed.upsert(spark, name, rows(spark, [], ""))
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["id", "content", "embedding"]
    managed.upsert(spark, name, rows(spark, [5], "it's \\ a"))
    assert held(spark, name) == {5: "it's \\ a 5"}
    with pytest.raises(ValueError):
        managed.upsert(spark, name, spark.createDataFrame([(1, "x")], "id long, other string"))
    spark.createDataFrame([(1,)], "id int").write.saveAsTable(f"{name}_table")
    with pytest.raises(ValueError):
        managed.upsert(spark, f"{name}_table", rows(spark, [1], ""))
    spark.sql(f"DROP TABLE {name}_table")
