"""The pipeline's near-dedup stage against all pairs' similarity."""

from __future__ import annotations

import random


def shingles(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def kept_of_all_pairs(rows: list[tuple]) -> set:
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0] for i in range(len(rows)) if up[i] == i}


def test_large_groups_are_searched_in_blocks(spark, prose_of, monkeypatch):
    from tidemark.llm import jaccard

    rng, rows = random.Random(5), []
    common = [f"k{i}" for i in range(40)]
    for i in range(60):  # all share most of their shingles, few are that similar
        w = common + prose_of(rng, 12).split()
        rows.append(" ".join(w))
        if i % 3 == 0:
            rows.append(" ".join([*w[:-1], f"other{i}"]))
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], corpus_docs).repartition(3)
    want = kept_of_all_pairs(rows)
    monkeypatch.setattr(jaccard, "SMALL_GROUP", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "KNOWN_SHINGLES", 1)
    assert {r.doc_id for r in jaccard.keep_one(frame).collect()} == want and len(want) == 60


def test_packed_sets_open_again():
    import numpy as np

    from tidemark.llm import jaccard

    x = np.array([5, 1 << 39, 7, 5, (1 << 63) + 9], np.uint64)
    assert jaccard._opened(jaccard._packed(x)).tolist() == [5, 7, 9, 1 << 39]
    assert len(jaccard._opened(jaccard._packed(x[:0]))) == 0


def test_stage_keeps_one_of_all_pairs_at_similarity_0_8(spark, prose_of):
    import corpus_pipeline
    from tidemark.llm import jaccard

    rng, rows = random.Random(11), []
    line = prose_of(rng, 30)
    for i in range(40):
        w = prose_of(rng, rng.randint(60, 300)).split()
        rows.append(" ".join(w) if i % 3 else f"{' '.join(w)} {line}")
        for changes in (len(w) // 60, len(w) // 25):  # similarities around 0.84 and 0.67
            near = list(w)
            for at in rng.sample(range(len(w)), changes):
                near[at] = prose_of(rng, 1) + "q"
            rows.append(" ".join(near))
    rows += ["A b c d e F", "a b  c d e f", "a b c", "a b c", "", " \n", None]
    for k in range(60):  # near copies in a chain, each 0.8 like the next alone
        rows.append(" ".join(f"c{j}" for j in range(6 * k, 6 * k + 58)))
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], corpus_docs).repartition(3)
    want = kept_of_all_pairs(rows)
    assert {r.doc_id for r in corpus_pipeline.dedupe(spark, frame, "").collect()} == want and len(want) < len(rows) - 60
    assert {r.doc_id for r in jaccard.keep_one(frame, sample_rows=10).collect()} == want
    assert corpus_pipeline.dedupe(spark, frame.limit(0), "").count() == 0


corpus_docs = "doc_id long, text string, lang string, source string, n_chars long"
