"""Streaming ingest over many batches: bounded folders, replays, deletions, merges that break off."""

from __future__ import annotations

import pytest

from tidemark.providers import GenAIEmbeddingClient
from tidemark.session import list_paths
from tidemark.streaming import ingest

CLIENT = GenAIEmbeddingClient("hash", dim=4)


def batch(spark, path, number, rows, most=4):
    """What start_ingest() does with one micro-batch."""
    stream = ingest.chunked(spark.createDataFrame(rows, ingest.DOCUMENT_SCHEMA), 20, 0)
    ingest.with_embedding(stream.dropDuplicates(["filename", "chunk_id"]), CLIENT, "content").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return ingest.compact(spark, path, number, most)


def held(spark, path):
    out = {}
    for r in ingest.read_latest(spark, path).orderBy("filename", "chunk_id").collect():
        out.setdefault(r.filename, []).append(r.content)
    return out


def test_many_batches_leave_few_folders(spark, tmp_path):
    path, want, merges = str(tmp_path / "ix"), {}, 0
    for n in range(24):
        rows = [(f"f{n % 5}", f"version {n}"), (f"g{n}", "only once"), (f"g{n - 3}", None if n % 2 else "")]
        merges += batch(spark, path, n, rows)
        want |= {name: [text] for name, text in rows if text}
        want.pop(f"g{n - 3}", None)
        assert len(list_paths(spark, path)) <= 4 + 2
    assert held(spark, path) == want and merges >= 4
    batch(spark, path, 23, [("f0", "again")])  # the last batch is run again, with other rows
    want = {k: v for k, v in want.items() if k != "f0"} | {"f0": ["again"]}
    got = held(spark, path)
    assert got["f0"] == ["again"] and got["f4"] == want["f4"] and "g23" not in got


@pytest.mark.parametrize("step", ["write", "delete_path"])
def test_a_broken_merge_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "ix")
    for n in range(6):
        batch(spark, path, n, [("a", f"text {n}"), (f"b{n}", "x")], most=100)
    want = held(spark, path)
    with monkeypatch.context() as m:
        m.setattr(ingest, "_rows" if step == "write" else step, lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.compact(spark, path, 5, 2)
    assert held(spark, path) == want and want["a"] == ["text 5"]
    batch(spark, path, 6, [("a", None)], most=1)
    del want["a"]
    assert held(spark, path) == want


def test_stream_replaces_deletes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST", 1)
    monkeypatch.setattr(ingest.compact, "__defaults__", (1,))
    source, path = str(tmp_path / "in"), str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        ingest.read_latest(spark, path)
    for rows in ([("a", "first version of a long text"), ("b", "other")], [("a", "second")], [("b", None)], [("c", "new")]):
        spark.createDataFrame(rows, ingest.DOCUMENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.chunked(ingest.documents_stream(spark, source), 20, 0)
        ingest.start_ingest(stream, CLIENT, path, str(tmp_path / "cp"), available_now=True).awaitTermination(60)
    assert held(spark, path) == {"a": ["second"], "c": ["new"]}
    assert any("upto=" in p for p in list_paths(spark, path)) and len(list_paths(spark, path)) <= 3
