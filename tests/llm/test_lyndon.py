"""Runs of words against every stretch tried in turn, and op11 against its contract in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lyndon, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, least=6, power=4):
    """For each period the longest stretches that keep it, if no smaller period does."""
    out, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, power * q) and not any((i, j + q - i) == (s, length) for s, length, _ in out):
                out[i, j + q - i, q] = None
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=6))
def test_runs_equal_brute_force(parts):
    w = [x for part, times in parts for x in part * times]
    assert lyndon.find_runs(np.array(w, np.int64)) == all_runs(w)
    assert lyndon.text_runs([b"%d" % x for x in w]) == all_runs(w)
    assert lyndon.find_runs(np.array(w, np.int64), 4, 3) == all_runs(w, 4, 3)


def test_long_repetitions_and_false_hashes(monkeypatch):
    rng = random.Random(3)
    root = [rng.randrange(50) for _ in range(200)]
    w = [rng.randrange(50) for _ in range(900)] + root * 5 + root[:123] + [7] * 300 + [rng.randrange(50) for _ in range(500)]
    want = all_runs(w)
    assert (900, 1123, 200) in want and lyndon.find_runs(np.array(w)) == want
    monkeypatch.setattr(lyndon, "MODULUS", 3)  # most stretches look alike: words decide
    monkeypatch.setattr(lyndon, "BASE", 2)
    assert lyndon.find_runs(np.array(w)) == want
    assert lyndon.text_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    assert lyndon.text_runs([b"a"] * 5) == [] and lyndon.text_runs([]) == []


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_follows_its_contract(spark, docs, no_docs, texts, tmp_path):
    extra = [(i, "x y z " * 9 + "x\x1cy z") for i in range(400, 470)] + [(500, "a " * 40 + "b a b a b a b a\tb\x0ba"), (501, "é " * 7)]
    extra += [(502, "\n" * 200_000 + "w " * 6), (503, "k" * 200_000)]
    others = docs.first()[2:]
    frame = docs.unionByName(spark.createDataFrame([(i, t, *others) for i, t in extra], docs.schema))
    for name, rows in (("some", frame), ("none", no_docs)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = queries.op11_lyndon_runs(spark, f"{tmp_path}/some")
    want = [contract(i, t) for i, t in [*texts, *extra]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 70 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None)
    assert queries.op11_lyndon_runs(spark, f"{tmp_path}/none").count() == 0


def test_collapsed_texts(spark):
    got = lyndon.word_runs(spark.createDataFrame([(1, "so " + "la di da " * 5 + "end")], "doc_id long, text string")).first()
    assert got.collapsed == "so la di da end" and [tuple(r) for r in got.runs] == [(1, 15, 3)] and got.n_words == 17
