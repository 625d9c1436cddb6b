"""Shards against every way to cut, and op12's rows against its contract."""

from __future__ import annotations

import itertools
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import queries, sharding


def loads(sizes, cuts, shards):
    """Sums of shards that cuts, as (size, number of that size before), make of descending sizes."""
    firsts = {}
    for i, s in enumerate(sizes):
        firsts.setdefault(s, i)
    at = [0, *(firsts[s] + nth for s, nth in cuts), len(sizes)]
    at += [len(sizes)] * (shards + 1 - len(at))
    assert at == sorted(at)
    return [sum(sizes[a:b]) for a, b in itertools.pairwise(at)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=0, max_size=9), st.integers(1, 5))
def test_largest_shard_is_as_small_as_any_cuts_allow(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    kinds = sorted(set(sizes), reverse=True)
    got = loads(sizes, sharding.minimax_cuts(kinds, [sizes.count(k) for k in kinds], shards), shards)
    n, best = len(sizes), None
    for middle in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        tried = sorted((sum(sizes[a:b]) for a, b in itertools.pairwise([0, *middle, n])), reverse=True)
        best = tried[0] if best is None else min(best, tried[0])
    assert len(got) == shards and sum(got) == sum(sizes) and max(got, default=0) == best


def test_a_huge_group_leaves_even_shards():
    got = loads([1000, *[3] * 100, *[1] * 400], sharding.minimax_cuts([1000, 3, 1], [1, 100, 400], 8), 8)
    assert got == [1000, *[102, 102], *[100] * 5] or (got[0] == 1000 and max(got[1:]) - min(got[1:]) <= 12)


def checked(rows, texts):
    """The contract: whole groups, gapless places, sizes and checksums; the shards' bytes."""
    assert len(rows) == len(texts)
    expected = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == expected
    homes, places, sums = {}, {}, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        assert homes.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        places.setdefault(r.shard, []).append(r.slot)
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    for slots in places.values():
        assert sorted(slots) == list(range(len(slots)))
    return [sums.get(s, 0) for s in range(24)]


def test_query_follows_its_contract(spark, docs, no_docs, texts, tmp_path):
    spread = [(1000 + i, f"text number {i} " * (1 + i % 7)) for i in range(1500)]
    copies = [(5000 + i, "copy of one text " * 4) for i in range(900)]
    same = [(7000 + i, f"{i:04}") for i in range(2000)]  # one size, parted by a cut
    rows = [*texts, *spread, *copies, *same]
    others = docs.first()[2:]
    frame = docs.unionByName(spark.createDataFrame([(i, t, *others) for i, t in rows[len(texts) :]], docs.schema))
    frame.write.parquet(f"{tmp_path}/some/documents.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    sums = checked(queries.op12_minimax_shards(spark, f"{tmp_path}/some").collect(), rows)
    groups = {}
    for i, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len((t or "").encode()) + 8
    huge = [s for s in groups.values() if s > sum(groups.values()) / 24]
    rest = sorted(sums, reverse=True)[len(huge) :]
    assert sorted(sums, reverse=True)[: len(huge)] == sorted(huge, reverse=True) and max(rest) - min(rest) <= max(set(groups.values()) - set(huge))
    assert queries.op12_minimax_shards(spark, f"{tmp_path}/none").count() == 0
    again = queries.op12_minimax_shards(spark, f"{tmp_path}/some")
    assert again.agg(F.countDistinct("shard")).first()[0] == 24
    few = sharding.shard_documents(docs.where("doc_id in (1, 2, 3)"))
    assert sorted(r.slot for r in few.collect()) == [0, 0, 0]
