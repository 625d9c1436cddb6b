"""Phrases and their scores against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import phrases

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """How often each phrase of up to five words occurs, by language."""
    out = {}
    for lang, text in rows:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ABC)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    return out


def expected(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if " " not in p)
        known = {p: c for p, c in f.items() if c >= least}
        hidden = set()
        for p, c in known.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                hidden |= {q for i in range(len(w) - m + 1) if 100 * c >= 100 * f[q := " ".join(w[i : i + m])]}
        best = []
        for p, a in known.items():
            w = p.split(" ")
            if len(w) > 1 and p not in hidden:
                parts = [(f[" ".join(w[:k])], f[" ".join(w[k:])], k) for k in range(1, len(w))]
                score, _, x, r = min((1000 * a * n // (x * r), k, x, r) for x, r, k in parts)
                best.append((-score, -a, p.encode(), x, r))
        out += [(lang, i, p.decode(), -a, x, r, n, -s) for i, (s, a, p, x, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def zipf(rng, n, kinds):
    words = [f"w{i}" for i in range(kinds)]
    picked = rng.choices(words, [1 / (i + 1) for i in range(kinds)], k=n)
    return " ".join(w.upper() if rng.random() < 0.05 else w + rng.choice("....,;:!?\n\t") if rng.random() < 0.2 else w for w in picked)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(rng.choice(["en", "de", None]), zipf(rng, rng.randint(0, 300), 40)) for _ in range(120)]
    out += [("en", "of the people. " * 50 + "É é  x the\x1cend")] * 5 + [("fr", None), ("fr", ""), (None, "a " * 3000), ("de", "," * 5000), ("de", "z" * 90 + " " + "y" * 90)] * 3
    return out


@pytest.mark.parametrize("listed, partition", [(1 << 17, 1 << 19), (7, 50), (0, 1 << 19)])
def test_all_equal_plain_counting(spark, rows, monkeypatch, listed, partition):
    """With all words listed, with few of them and hot pivots spread over partitions, and with none."""
    monkeypatch.setattr(phrases, "PARTITION", partition)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 1500)
    monkeypatch.setattr(phrases, "COUNTED", 50)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(frame, least=4, top=60, listed=listed)
    assert sorted(map(tuple, got.collect())) == expected(rows, 4, 60)
    if listed:
        return
    found, totals = phrases.frequent_phrases(frame, 4, listed=5)
    want = {(lang, p, c) for lang, f in counted(rows).items() for p, c in f.items() if c >= 4}
    assert {(r.lang, r.phrase, r.a) for r in found.collect()} == want and found.count() == len(want)


def test_edges(spark, docs, no_docs, texts):
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    want = expected([("en", t) for _, t in texts], 3, 50)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, top=50).collect())) == want


def test_fragments_own_each_ngram_once():
    rng = random.Random(2)
    ids = np.array([rng.randrange(0, 5) for _ in range(2000)], np.int32)
    rows, times = phrases._grouped(phrases.fragments(ids))
    w = ids.tolist()
    for m in range(2, 6):
        grams, n = phrases._owned(rows, times, m)
        want = Counter(tuple(w[i : i + m]) for i in range(len(w) - m + 1) if 0 not in w[i : i + m])
        assert dict(zip(map(tuple, grams.tolist()), n.tolist())) == want
