"""Kept model calls, event time with late rows, arrays with brackets in strings, order in two steps."""

from __future__ import annotations

import datetime as dt
import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark import ledger
from tidemark.functions import text as tx
from tidemark.operators import ordering
from tidemark.providers import GenAIChatClient
from tidemark.streaming import windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


class Counting(GenAIChatClient):
    """Notes its calls in a file; fails at one prompt while a second file is there."""

    path = ""

    def chat(self, user_input, *args, **more):
        import os

        with open(self.path, "a") as f:
            f.write(user_input + "\n")
        if user_input == "p7" and os.path.exists(self.path + ".fails"):
            raise OSError("the network is gone")
        return super().chat(user_input, *args, **more)


@pytest.fixture
def client(tmp_path):
    made = Counting("stub", replies={"p3": "three"})
    made.path = str(tmp_path / "calls")
    (tmp_path / "calls").touch()
    return made


def calls(client):
    return open(client.path).read().split()


def test_a_broken_job_asks_nothing_twice(spark, tmp_path, client):
    rows = [(i, f"p{i % 20}") for i in range(60)] + [(100, None)]
    frame, path = spark.createDataFrame(rows, "id int, p string").repartition(3), f"{tmp_path}/ledger"
    (tmp_path / "calls.fails").touch()
    with pytest.raises(Exception, match="network is gone"):
        ledger.with_kept_reply(frame, client, "p", path, at_a_time=2).collect()
    asked = calls(client)
    assert "p7" in asked
    (tmp_path / "calls.fails").unlink()
    got = {r.id: r.reply for r in ledger.with_kept_reply(frame, client, "p", path, at_a_time=2).collect()}
    assert got == {i: None if p is None else "three" if p == "p3" else p for i, p in rows}
    after = calls(client)
    assert sorted(set(after)) == sorted({p for _, p in rows if p}) and all(after.count(p) == 1 + (p == "p7" and asked.count("p7")) for p in set(after))
    ledger.with_kept_reply(frame, client, "p", path, max_tokens=1024).collect()
    assert calls(client) == after and not list((tmp_path / "ledger/waiting").iterdir())
    other = Counting("stub", "another model")
    other.path = client.path
    ledger.with_kept_reply(frame.where("id < 2"), other, "p", path).collect()
    assert len(calls(client)) == len(after) + 2


def test_errors_are_told_and_asked_again(spark, tmp_path, client):
    frame = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id int, p string")
    (tmp_path / "calls.fails").touch()
    path = f"{tmp_path}/ledger"
    ask = lambda: {r.id: (r.reply, r.error) for r in ledger.with_kept_reply(frame, client, "p", path, error_col="error", at_a_time=3).collect()}
    assert ask()[7] == (None, "the network is gone")
    (tmp_path / "calls.fails").unlink()
    got = ask()
    assert got[7] == ("p7", None) and got[3] == ("three", None) and calls(client).count("p7") == 2 and len(calls(client)) == 11
    none = spark.createDataFrame([], "id int, p string")
    assert ledger.with_kept_reply(none, client, "p", f"{tmp_path}/other").count() == 0


def test_tasks_share_a_rate(spark, tmp_path, client):
    frame = spark.createDataFrame([(f"q{i}",) for i in range(12)], "p string")
    began = time.monotonic()
    ledger.with_kept_reply(frame, client, "p", f"{tmp_path}/ledger", at_a_time=2, calls_a_minute=240).collect()
    assert time.monotonic() - began > 60 * 12 / 240 - 2 * 0.5 - 0.1  # the first call of each task needn't wait


def at(minute, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


def arrive(spark, folder, rows):
    full = [(i, t, u, "click", v, None) for i, (t, u, v) in enumerate(rows)]
    spark.createDataFrame(full, windows.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_sessions_close_and_late_rows_are_dropped(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    run = lambda: sorted(((r.user_id, r.n, r.total) for r in windows.drained(spark, folder, windows.EVENTS, windows.sessions, out, state).collect()), key=str)
    arrive(spark, folder, [(at(0), 1, 1.0), (at(20), 1, 2.0), (at(5), 2, 4.0), (at(100), 2, None), (None, 1, 9.0), (at(3), None, 9.0)])
    assert run() == [(2, 1, 4.0)]  # open until minute 35, and the watermark is at 40
    arrive(spark, folder, [(at(25), 1, 8.0), (at(300), 3, 1.0)])  # late, but within the hour behind minute 100
    arrive(spark, folder, [])
    assert set(run()) >= {(1, 3, 11.0), (2, 1, 4.0), (2, 1, None)}
    arrive(spark, folder, [(at(26), 1, 100.0), (at(0, 3), 3, 1.0)])  # too late: dropped
    arrive(spark, folder, [(at(0, 9), 3, 1.0)])
    got = run()
    assert (1, 3, 11.0) in got and not any(total and total >= 100 for _, _, total in got) and (3, 1, 1.0) in got


def test_windows_of_a_table_overlap(spark):
    rows = [(0, at(30), 1, "a", 1.0, None), (1, at(90), 1, "a", 2.0, None), (2, at(30), 1, "b", None, None)]
    got = windows.windows(spark.createDataFrame(rows, windows.EVENTS), "2 hours", "1 hour").collect()
    assert sorted(((r.event_type, r.start.hour, r.n, r.total) for r in got), key=str) == [("a", 0, 2, 3.0), ("a", 1, 1, 2.0), ("a", 23, 1, 1.0), ("b", 0, 1, None), ("b", 23, 1, None)]


REPLIES = [
    ('say [{"a": "x ] y"}] and ]', [{"a": "x ] y"}]), ('[{"a": "\\"] \\\\"}]', [{"a": '"] \\'}]), ('[{"a": [1, [2]]}, {"b": "["}] [', [{"a": [1, [2]]}, {"b": "["}]),
    ('[{"a": "1",}, ]', [{"a": "1"}]), ('[{"a": "b, ]"}]', [{"a": "b, ]"}]), ("[1, 2", None), ("none", None), ("", None), (None, None), ("] [ ]", []), ("x" * 1000 + "[" * 2000 + "]" * 2000, None),
]


def test_lenient_arrays(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, r string")
    got = {r.i: r.found for r in frame.select("i", tx.lenient_json_array(F.col("r")).alias("found")).collect()}
    for i, (_, want) in enumerate(REPLIES[:-1]):
        assert (None if got[i] is None else json.loads(got[i])) == want, REPLIES[i]
    assert got[len(REPLIES) - 1] == "[" * 2000 + "]" * 2000
    strict = frame.where("i = 0").select(tx.first_json_array(F.col("r"))).first()[0]
    assert strict == '[{"a": "x ]'


def test_many_bounds_give_the_same_order(spark, monkeypatch):
    frame = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 30).alias("o"))
    want = {(r.k, r._bucket) for r in ordering.bucketed(frame, "o", 40).collect()}
    monkeypatch.setattr(ordering, "STEPS", 5)
    assert {(r.k, r._bucket) for r in ordering.bucketed(frame, "o", 40).collect()} == want and len({b for _, b in want}) > 30
    at = [(r.id, r.o if r.o is not None else -1) for r in ordering.with_position(frame, "o").orderBy("id").collect()]
    assert [i for i, _ in at] == list(range(4000)) and [o for _, o in at] == sorted(o for _, o in at)
