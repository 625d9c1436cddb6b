"""Operators over documents against plain restatements."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, packing, quality, simhash, suffixes, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(*x):
    return tuple((v is None, v) for v in x)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_tokenizer(texts, whole):
    own = bpe.load(bpe.default_path())
    odd = ["", " ", "  a", "a ", "\n a", "a\n b\n\n c", "it's, we'll. 12,3", "a  b", "x  y", "tab\tt  \r\n z", "<|endoftext|> a\n <|endoftext|>", ".", " ,", "a. b, c.d"]
    for t in odd + [t for _, t in texts if t]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:50])


def test_packing_covers_every_token_once(docs, no_docs, texts, whole):
    rows = packing.pack_powers(docs, limit=64).withColumn("crc", F.crc32("ids")).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.length == 1 << r.bucket and r.length <= 64 and r.offset == 0 for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
    for i, t in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[(i, len(ids))])
        if sum(1 for j, u in texts if j == i and len(whole.encode(u or "", add_special_tokens=False).ids) + 1 == len(ids)) == 1:
            assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
            assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces[:-1]]).tolist()
    assert packing.pack_powers(no_docs).count() == 0
    assert packing.piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    with pytest.raises(ValueError):
        packing.pack_powers(docs, limit=100)


def test_token_counts_add_up(docs, no_docs, whole, spark):
    for r in token_counts.count_tokens(docs).collect():
        assert sum(r.section_tokens) == r.n_tokens == sum(r.field_tokens) and len(r.section_tokens) == r.n_sections
    assert token_counts.count_tokens(no_docs).count() == 0
    one = spark.createDataFrame([(1, "ab\n\n\nc", None), (2, None, None)], "doc_id long, t string, u string")
    for rule in token_counts.RULES:
        got = {r.doc_id: r for r in token_counts.count_tokens(one, fields=["t", "u"], rule=rule).collect()}
        assert got[1].n_tokens == len(whole.encode("ab\n\n\nc\n", add_special_tokens=False).ids) and len(got[1].field_tokens) == 2
        assert got[1].n_sections == 4
    widths, starts = np.array([2, 3, 4]), np.array([0, 3, 5])
    assert token_counts.attribute(widths, starts, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(widths, starts, "last")[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(widths, starts, "most")[0].tolist() == [1, 1, 1]
    assert token_counts.attribute(widths, starts)[1] == 1


def plain_attributed(whole, text: str, starts: list[int], rule: str) -> list[int]:
    """Tokens per section, byte by byte, from the tokenizer's own tokens."""
    letters, out, at = bpe._byte_letters(), [0] * len(starts), 0
    for token in whole.encode(text, add_special_tokens=False).tokens:
        n = len(token.encode() if token in ("<|endoftext|>",) else bytes(letters[c] for c in token))
        of = [max(k for k, s in enumerate(starts) if s <= p) for p in range(at, at + n)]
        best = of[0] if rule == "first" else of[-1] if rule == "last" else max(sorted(set(of)), key=of.count)
        out[best] += 1
        at += n
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_and_fields_equal_the_tokenizer(spark, texts, whole, rule):
    rows = [(i, f"s{i}" if i % 3 else None, t) for i, (_, t) in enumerate(texts) if t is None or len(t) < 3000]
    rows += [(900, "a\n", "\n\n\nx\n \n y"), (901, "é", "漢\n漢  \n\t\t\n漢"), (902, "", "it's\nwe'll\n\n12,3\n")]
    frame = spark.createDataFrame(rows, "doc_id long, a string, b string")
    for r in token_counts.count_tokens(frame, fields=["a", "b"], rule=rule).collect():
        a, b = next((a or "", b or "") for i, a, b in rows if i == r.doc_id)
        text = f"{a}\n{b}"
        raw = text.encode()
        lines = [p for p in [0] + [k + 1 for k, c in enumerate(raw) if c == 10] if p < len(raw)]
        assert r.section_tokens == plain_attributed(whole, text, lines, rule), text[:80]
        assert r.field_tokens == plain_attributed(whole, text, [0, len(a.encode()) + 1], rule), text[:80]


def test_buckets_hold_equal_lengths(docs, spark, tmp_path):
    packed = packing.pack_powers(docs, limit=64)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("length <> shiftleft(1, bucket)").count() == 0
    key_ = ["doc_id", "start", "length", "ids"]
    assert sorted(map(str, back.select(key_).collect())) == sorted(map(str, packed.select(key_).collect()))


def test_caches_hold_no_long_pieces(whole):
    own, long = bpe.load(bpe.default_path()), "x" * 5000
    own.encode(f"a {long} {long} b")
    assert long not in own.cache and own.cache.chars <= bpe.CACHE_CHARS + 100
    score = toxicity.ToxicModel(np.zeros(1 << 10, np.float32), 0.0, 16).scorer()
    assert score(f"a {long}") == 0.5
    assert not any(len(w) > toxicity.CACHED_WORD for c in score.__closure__ if isinstance(c.cell_contents, dict) for w in c.cell_contents)


def test_scores_equal_a_plain_restatement():
    rng = np.random.default_rng(5)
    model = toxicity.ToxicModel(rng.normal(size=1 << 10).astype(np.float32) * 3, -0.2, 4)
    score = model.scorer()

    def value(word):
        ids = toxicity.grams(word, 1 << 10)
        return sum(float(model.pull[i]) for i in ids) / len(ids) if ids else 0.0

    for text in ["", None, "one", "a b c d e f g", "Same same same other", "x! ... ?? y", " ".join(f"w{i}" for i in range(50))]:
        words = (text or "").lower().split()
        values = [0.0 if k and words[k - 1] == w else value(w) for k, w in enumerate(words)]
        top = max([sum(values[i : i + 4]) for i in range(0, len(values), 4)] or [0.0])
        assert score(text) == pytest.approx(1 / (1 + np.exp(-(top / 4 - 0.2))), abs=1e-6)


def test_a_hot_passage_within_blobs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i // 2, f"{word()} {word()} {passage if i % 3 else passage[: 100 + i]} {word()}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want, seen = Counter(), {}
    for i, t in rows:
        for p in range(len(t) - 49):
            seen[t[p : p + 50]] = min(seen.get(t[p : p + 50], i), i)
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        want[i, sum(gone), "".join(c for c, g in zip(t, gone) if not g)] += 1
    for parts, size in ((1, suffixes.BLOB_BYTES), (4, suffixes.BLOB_BYTES), (1, 2000)):
        monkeypatch.setattr(suffixes, "BLOB_BYTES", size)
        got = suffixes.drop_repeats(frame.repartition(parts)).collect()
        assert Counter((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in got) == want


def plain_fingerprint(text, n=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(points, radius):
    up = list(range(len(points)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(points):
        for j in range(i):
            if bin(a ^ points[j]).count("1") <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(x) for x in range(len(points))]


@pytest.mark.parametrize("radius", [3, 24])
def test_simhash_classes(docs, no_docs, texts, radius):
    got = simhash.near_classes(docs, radius=radius, shard_rows=8).collect()
    fps = [plain_fingerprint(t) for _, t in texts]
    assert Counter(key(r.doc_id, r.fp % 2**64) for r in got) == Counter(key(i, f) for (i, _), f in zip(texts, fps))
    roots = plain_components(fps, radius)
    least = {}
    for (i, _), r in zip(texts, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = Counter(key(i, f, least.get(r)) for (i, _), f, r in zip(texts, fps, roots))
    assert Counter(key(r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs, radius=radius, shard_rows=8)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.near_classes(no_docs).count() == 0 == simhash.keep_one(no_docs).count()


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    tree = simhash.VantageTree(points, 5, 3)
    leaf, row, home = tree.homes_and_visits(points)
    assert home.sum() == len(points)
    forest = simhash.Forest(len(points))
    for shard in np.unique(leaf):
        rows = row[leaf == shard]
        part = simhash.Forest(len(rows))
        simhash.link_within(points[rows], np.flatnonzero(home[leaf == shard]), 3, part, leaf=8)
        forest.link(rows, rows[part.roots(np.arange(len(rows)))])
    want = plain_components([int(p) for p in points], 3)
    got = forest.roots(np.arange(len(points)))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_suffix_runs_equal_brute_force(docs, no_docs, texts, monkeypatch):
    want, seen = Counter(), {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s, at = b[p : p + 50], 2**70 if i is None else i
            seen[s] = min(seen.get(s, at), at)
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < (2**70 if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[key(i, len(b), sum(gone), len([m for m in re.finditer(b"\1+", gone)]), hashlib.sha256(kept).hexdigest())] += 1
    for size in (suffixes.RANGE_BYTES, 20_000):
        monkeypatch.setattr(suffixes, "RANGE_BYTES", size)
        got = suffixes.drop_repeats(docs, digest=True).collect()
        assert Counter(key(*r) for r in got) == want
    assert suffixes.drop_repeats(no_docs).count() == 0


def test_loser_tree_merges_with_prefixes():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            s = sorted({bytes(rng.integers(97, 99, 6).tolist()) for _ in range(rng.integers(0, 20))})
            shares = [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(s, s[1:])]
            runs.append((s, [0, *shares] if s else []))
        order, at, share = suffixes.merge_runs(runs)
        merged = [runs[r][0][i] for r, i in zip(order, at)]
        assert merged == sorted(x for s, _ in runs for x in s)
        assert share[1:] == [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(merged, merged[1:])]


def plain_statistics(t):
    w = WORD.findall(t or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(docs, no_docs, texts, spark):
    got = Counter(key(r.doc_id, *(r[s] for s in quality.STATS[:5])) for r in quality.rule_statistics(docs).collect())
    assert got == Counter(key(i, *plain_statistics(t)) for i, t in texts)
    more = ["a b c a b c", "a a a a", "x\nx\n \nx\n", "#* $|", "\x1c  b"]
    assert [quality.text_statistics(t)[:5] for t in more] == [plain_statistics(t) for t in more]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.isolate(no_docs, labels).count() == 0
    judged = quality.isolate(docs, labels).collect()
    assert all(r.kept == (not r.base_failed) for r in judged)  # nothing to set a limit by


def test_forest_tells_junk_by_labels(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 80)) for _ in range(300)]
    junk = [" ".join(f"w{n}%%" for n in rng.integers(0, 10**6, 80)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(330) if i % 2], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.isolate(docs, labels, trees=50).collect() if r.kept}
    assert kept == set(range(300))


def test_toxicity_held_out_and_misspelt(spark, docs, no_docs, texts, prose_of):
    rng = random.Random(2)
    bad = ["grubworm", "snotface", "pigbrain"]
    rows = []
    for i in range(1200):
        w = prose_of(rng, rng.randint(20, 120)).split()
        if i % 3 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1200)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got if r.held_out]) > 0.97
    model = toxicity.learn(frame, labels)
    score = model.scorer()
    clean = prose_of(rng, 30)
    assert score(clean) < 0.5 < score(f"{clean} grubwormm snotfacce pigbrrain")
    assert 0 <= score("") == score(None) <= 1
    edge = toxicity.toxicity(docs, labels)
    assert edge.count() == len(texts) and edge.where("score is null or held_out is null").count() == 0
    assert toxicity.toxicity(no_docs, labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_mixing_targets_and_copies(docs, no_docs, texts, spark):
    sizes = spark.createDataFrame([("b", 100), ("a", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a 3, b 1, c 2, null 3; 1665 words to give, b's cap 200, null's 20, c's 0
    assert got == {"a": 1665 - 220.0, "b": 200.0, None: 20.0, "c": 0.0}
    rng = random.Random(6)
    many = [(f"s{k:03}", rng.choice([0, 5, 10, 10, 30, 60, 1000])) for k in range(200)] + [(None, 40)]
    weight = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(many)}
    target, open_, rest = {}, dict(many), 1.5 * sum(n for _, n in many)
    while full := {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * open_[s]}:
        target |= {s: 2.0 * open_[s] for s in full}
        rest -= sum(2 * open_.pop(s) for s in full)
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    frame = spark.createDataFrame(many, "source string, source_size long").repartition(3)
    assert {r.source: r.target for r in mixing.source_targets(frame).collect()} == pytest.approx(target)
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(texts)
    assert Counter(key(r.doc_id, r["size"]) for r in plan) == Counter(key(i, len(WORD.findall(t or ""))) for i, t in texts)
    assert all(0 <= r.copies <= 2 and r.copies in (int(r.rate), int(r.rate) + 1) for r in plan)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mixing_plan(no_docs).count() == 0 == mixing.mix_documents(no_docs).count()
