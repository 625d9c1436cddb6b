"""Conversations in rounds: the loop's answers, and effects that happen once though tasks fail."""

from __future__ import annotations

import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle

from tidemark.operators import agents

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module

SCHEMA = f"conv_id int, messages {agents.MESSAGES}"


def send(history):
    """Adds up to its number of steps, then tells the tools' results; conversation 4 never ends, 5 asks for an unknown tool."""
    who, told = history[0]["content"], [m["content"] for m in history if m["role"] == "tool"]
    if who == "5" and not told:
        return json.dumps({"tool_calls": [{"name": "nothing"}, {"name": "note", "arguments": {"who": who, "n": 0}}]})
    if who != "4" and len(told) >= int(who):
        return json.dumps({"final_answer": " ".join(told) or "at once"})
    return json.dumps({"tool_calls": [{"name": "note", "arguments": {"who": who, "n": len(told)}}]})


def tools(folder, fail_at=None):
    def note(who, n):
        with open(f"{folder}/{who}-{n}-{uuid.uuid4().hex}", "w"):
            pass
        return {"noted": n}

    def adapter():
        def asked(history):
            if fail_at and history[0]["content"] == fail_at and len(history) > 2 and not os.path.exists(f"{folder}/mended"):
                os._exit(1)  # the worker is gone
            return send(history)

        return agents.JsonFunctionAdapter(asked)

    return adapter, [agents.Tool("note", "Notes.", {"type": "object"}, note)]


def talks(spark):
    rows = [(i, [("user", str(i), None, None)]) for i in range(6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def told(frame):
    return {r.conv_id: (r.answer, [tuple(m) for m in r.messages]) for r in frame.collect()}


def test_rounds_answer_as_the_loop_and_effects_happen_once(spark, tmp_path):
    for name in ("a", "b", "journal"):
        (tmp_path / name).mkdir()
    want = told(agents.run_agents(talks(spark), *tools(tmp_path / "a")))
    assert want[4][0] == agents.OUT_OF_STEPS and want[0][0] == "at once" and "Unknown tool" in want[5][0]
    with pytest.raises(Exception):
        agents.run_agents_in_rounds(talks(spark), *tools(tmp_path / "b", "3"), str(tmp_path / "journal")).collect()
    before = os.listdir(tmp_path / "b")
    assert before
    (tmp_path / "b" / "mended").touch()
    got = told(agents.run_agents_in_rounds(talks(spark), *tools(tmp_path / "b", "3"), str(tmp_path / "journal")))
    assert got == want
    effects = sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path / "b") if n != "mended")
    assert effects == sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path / "a")) and len(effects) == len(set(effects))
    assert told(agents.run_agents_in_rounds(talks(spark), *tools(tmp_path / "b"), str(tmp_path / "journal"))) == want
    assert len(os.listdir(tmp_path / "b")) == len(effects) + 1
    none = spark.createDataFrame([], SCHEMA)
    assert agents.run_agents_in_rounds(none, *tools(tmp_path / "b"), str(tmp_path / "other")).count() == 0
