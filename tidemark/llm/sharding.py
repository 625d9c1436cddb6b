"""Shards of nearly equal bytes that keep groups whole: a minimax contiguous partition.

Documents of equal text form a group, which no cut divides. Groups stand in
order of size, largest first, equal sizes by their text's digest, and shards are
contiguous in that order. The smallest capacity with which all groups fit into
the shards is found by binary search, each capacity checked greedily. Cuts are made
under it: a shard is filled as the greedy pass fills it, or to an even share of
what is left where the rest still fits, so that the last isn't short. A group that is larger than an even
share of what is left has a shard to itself, and the rest is solved again:
otherwise one huge group would set the capacity of all and leave shards empty.

In that order the list of sizes is told by how many groups have each size. Those
counts are all that the driver reads, 16 bytes for each different size, and
different sizes that add up to S are fewer than the root of 2 S: 15 million for
100 TB if every size up to there occurred. With sums before each size a greedy
pass is one search per shard.

Everything else is native. Texts are read once, and per document only its id,
size, checksum and digest move. Groups of more than a thousandth of all rows, of
which there are fewer than a thousand, are broadcast; places within a shard are
counted in buckets by a hash of document and text, so a group of any size is
spread over all tasks.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

SHARDS = 24
#: Bytes that a document takes besides its text.
OVERHEAD = 8
#: Rows of a bucket in which places are counted, about.
BUCKET_ROWS = 1 << 20
#: A group of more than one in so many rows is heavy.
HEAVY = 1000


def minimax_cuts(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int]]:
    """Where each shard but the first begins, as (size, how many groups of that size come before).

    sizes are positive and descending, counts[i] groups have sizes[i]. Fewer
    than shards - 1 cuts mean that the last shards are empty.
    """
    kinds, before = len(sizes), [0]
    for size, n in zip(sizes, counts):
        before.append(before[-1] + size * n)
    whole, cuts = before[-1], []

    def reached(kind: int, nth: int) -> int:
        return before[kind] + (nth * sizes[kind] if nth else 0)

    def after(kind: int, nth: int) -> tuple[int, int]:
        return (kind, nth + 1) if nth + 1 < counts[kind] else (kind + 1, 0)

    def full(kind: int, nth: int, capacity: int) -> tuple[int, int]:
        """The first group that doesn't fit beside those from (kind, nth) on."""
        reach = reached(kind, nth) + capacity
        kind = bisect_right(before, reach) - 1
        return (kinds, 0) if kind >= kinds else (kind, (reach - before[kind]) // sizes[kind])

    def passes(at: tuple[int, int], capacity: int, left: int) -> list[tuple[int, int]]:
        """The ends of up to `left` shards."""
        made = []
        while at[0] < kinds and len(made) < left:
            at = full(*at, capacity)
            made.append(at)
        return made

    def ends(at: tuple[int, int], capacity: int, left: int) -> list[tuple[int, int]]:
        """Where the next shard may end: full, or about an even share of what is left if the rest then fits as well."""
        last = full(*at, capacity)
        even = full(*at, (whole - reached(*at)) // left)
        tried = [e for e in (even, after(*even) if even[0] < kinds else even) if at < e < last]
        return [last, *(e for e in tried if passes(e, capacity, left - 1)[-1] == (kinds, 0))]

    at, left = (0, 0), shards
    while at[0] < kinds and left > 1:
        kind, nth = at
        if sizes[kind] * left <= whole - reached(*at):
            break
        at = after(*at)
        cuts.append(at)
        left -= 1
    if at[0] < kinds and left > 1:
        kind, nth = at
        low = max(sizes[kind], -(-(whole - reached(*at)) // left))
        high = low + sizes[kind]
        while low < high:
            middle = (low + high) // 2
            if passes(at, middle, left)[-1] == (kinds, 0):
                high = middle
            else:
                low = middle + 1
        while at[0] < kinds and left > 1:
            at = min(ends(at, low, left), key=lambda end: abs(left * (reached(*end) - reached(*at)) - (whole - reached(*at))))
            cuts.append(at)
            left -= 1
    return [(sizes[kind], nth) for kind, nth in cuts if kind < kinds]


def _group_shards(groups: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """groups with their shard. Only groups of a size that a cut parts are numbered, in buckets by how their digest begins."""
    parted = sorted({size for size, nth in cuts if nth})
    size, nth = F.col("group_size"), F.col("nth")

    def shard(rank: Column) -> Column:
        begun = F.lit(0)
        for of, first in cuts:
            begun = begun + ((size < of) | ((size == of) & (rank >= first))).cast("int")
        return begun.alias("shard")

    if not parted:
        return groups.select("*", shard(F.lit(0)))
    inside = groups.where(size.isin(parted)).withColumn("head", F.substring("digest", 1, 3))
    before = Window.partitionBy("group_size").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = inside.groupBy("group_size", "head").agg(F.count("*").alias("n"))  # at most 4,096 for each cut
    heads = heads.select("group_size", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("group_size", "head").orderBy("digest")
    numbered = inside.join(F.broadcast(heads), ["group_size", "head"]).withColumn("nth", F.col("base") + F.row_number().over(within) - 1)
    outside = groups.where(~size.isin(parted)).select("*", shard(F.lit(0)))
    return outside.unionByName(numbered.select(*groups.columns, shard(nth)))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD
) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot): each document's shard and its place there.

    Sizes are the text's UTF-8 bytes and `overhead`. Shards are numbered from 0,
    places gapless from 0 in each, in an order that a hash shuffles. Null texts
    count as empty ones and form one group with them. Equal texts share a shard
    whatever their ids; rows that repeat an id have a place each. With fewer
    groups than shards some shards stay empty; no rows in: no rows out. Long
    texts are whole groups as any other. Other columns never matter.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("shards and overhead are at least 1")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest")
        )
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("group_size"), F.count("*").alias("n_rows")))
    sizes, counts = [], []
    for kind in groups.groupBy("group_size").agg(F.count("*").alias("n")).orderBy(F.desc("group_size")).toLocalIterator():
        sizes.append(kind.group_size)
        counts.append(kind.n)
    total = rows.count()
    placed = cut(_group_shards(groups, minimax_cuts(sizes, counts, shards)).select("digest", "n_rows", "shard"))
    is_heavy = F.col("n_rows") * HEAVY > total
    heavy = F.broadcast(placed.where(is_heavy).select("digest", "shard"))
    light = placed.where(~is_heavy).select("digest", "shard")
    sharded = rows.join(heavy, "digest").unionByName(rows.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest"))
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))
    sharded = cut(sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets))))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # a row for each shard and bucket
    bases = bases.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("digest", "doc_id")
    return sharded.join(bases, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "digest", "shard", (F.col("base") + F.row_number().over(within) - 1).alias("slot")
    )
