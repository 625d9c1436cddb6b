"""The pipeline's stages, one after the other, against plain Python, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: What the stages made one after the other, for run() to equal.
PACKED: Counter = Counter()
BAD = ["grubworm", "snotface", "pigbrain"]


def corpus(prose_of) -> tuple[list[tuple], dict]:
    """Rows, and the ids of toxic texts, copies, near copies and texts with something private."""
    rng, rows, planted = random.Random(21), [], {"toxic": set(), "copy": set(), "near": set(), "private": set()}

    def add(text, source="a", lang="en"):
        rows.append((len(rows), text, lang, source, len(text) if text is not None else None))
        return len(rows) - 1

    for i in range(600):
        w = prose_of(rng, rng.randint(65, 150)).split()
        if i % 4 == 0:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        here = add(" ".join(w), f"s{i % 3}")
        if i % 4 == 0:
            planted["toxic"].add(here)
        elif i % 20 == 1:
            planted["copy"].add(add(" ".join(w), "s1"))
        elif i % 20 == 2:
            at = rng.randrange(len(w))
            planted["near"].add(add(" ".join([*w[:at], "another", *w[at + 1 :]]), "s2"))
        elif i % 20 == 3:
            planted["private"].add(add(f"{prose_of(rng, 60)} write to ann.lee{i}@mail.example.com now", "s0"))
    for text in (None, "", " \n ", None):
        add(text, None, None)
    return rows, planted


@pytest.fixture(scope="module")
def tables(spark, prose_of, tmp_path_factory):
    rows, planted = corpus(prose_of)
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i in planted["toxic"])) for i, *_ in rows[:-4]]
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, planted


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_each_stage_equals_plain_python(spark, tables):
    path, rows, planted = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "private_data", "mix_sources", "pack"]
    by_id = {r[0]: r[1] for r in rows}

    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == COLUMNS
    left = {r.doc_id for r in clean.collect()}
    score = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet")).scorer()
    assert left == {i for i, t in by_id.items() if score(t) < 0.5}
    held_out = {i for i in by_id if zlib.crc32(str(i).encode()) % 5 == 0}
    asked = planted["toxic"] & held_out
    assert len(asked) > 15 and len(asked & left) <= 0.05 * len(asked) and set(by_id) - planted["toxic"] <= left

    once = stages["simhash_near_dedup"](spark, clean, path)
    kept = {r.doc_id for r in once.collect()}
    order, roots = sorted(left), {}
    sets = {i: shingles(by_id[i]) for i in order}
    for k, i in enumerate(order):
        alike = [j for j in order[:k] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        roots[i] = min([roots[j] for j in alike], default=i)
    assert once.columns == COLUMNS and kept == {i for i in order if roots[i] == i}
    assert len(kept & (planted["copy"] | planted["near"])) <= 1

    private = stages["private_data"](spark, once, path)
    texts = {r.doc_id: r.text for r in private.collect()}
    address = re.compile(r"ann\.lee\d+@mail\.example\.com")
    assert private.columns == COLUMNS and set(texts) == kept
    for i, t in texts.items():
        if i in planted["private"]:
            before, after = address.split(by_id[i])
            assert t.startswith(before) and t.endswith(after) and not address.search(t) and len(t) == len(by_id[i])
        else:
            assert t == by_id[i]
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in private.collect())

    mixed = stages["mix_sources"](spark, private, path)
    copies = Counter(r.doc_id for r in mixed.collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for i in texts:
        sizes[source[i]] += words[i]
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in full}
        open_, rest = open_ - full, rest - sum(2 * sizes[s] for s in full)
    assert mixed.columns == COLUMNS
    for i in texts:
        rate = target[source[i]] / sizes[source[i]] if sizes[source[i]] else 0
        assert int(rate) <= copies[i] <= int(rate) + 1
    for s in names[:-1]:
        assert sum(copies[i] * words[i] for i in texts if source[i] == s) == pytest.approx(target[s], rel=0.15)

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    pieces = {}
    for r in stages["pack"](spark, mixed, path).collect():
        pieces.setdefault((r.doc_id, r.start), []).append((r.length, r.ids_crc32, r.doc_tokens))
    want = {}
    for i, n in copies.items():
        ids = whole.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        at, left_ = 0, len(ids)
        while left_:
            size = min(2048, 1 << (left_.bit_length() - 1))
            part = np.array(ids[at : at + size], "<u4").tobytes()
            want[i, at] = [(size, zlib.crc32(part), len(ids))] * n
            at, left_ = at + size, left_ - size
    assert pieces == want
    PACKED.update((i, at, *p) for (i, at), found in pieces.items() for p in found)


def test_run_equals_its_stages(spark, tables):
    path, _, _ = tables
    assert PACKED  # by the test before
    got = corpus_pipeline.run(spark, path)
    rows = got.collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == PACKED
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_odd_tables(spark, tables, docs, no_docs):
    path, _, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, path).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    rows = docs.collect()
    assert docs.columns == no_docs.columns and len(rows) > 20  # other columns, clashing names among them, stay
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).select("doc_id").distinct().count() == len({r.doc_id for r in rows})
