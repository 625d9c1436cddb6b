"""Near-duplicates by SimHash fingerprints in a vantage-point tree.

1. One pass gives every whole text its 64-bit fingerprint; from here on only
   (id, fingerprint) moves, and equal fingerprints are one row.
2. A vantage-point tree over a hash-picked sample splits the
   fingerprints by Hamming distance into shards of about `shard_rows`. Every
   fingerprint has one home shard; by the triangle inequality only shards whose
   side of each split comes within `radius` can hold a partner, and it visits
   those too (of each two shards, the one that comes later).
3. Every shard searches its homes with a tree of its own, exactly, and returns
   a spanning forest of what it has linked, never the pairs.
4. Connected components of the forests give classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, may_be_among, over_texts
from .components import stars

HASH_SEED = 42
#: Fingerprints of a shard, sampled ones for its splits, and of those in all.
SHARD_ROWS, SAMPLE_PER_SHARD, SAMPLE_ROWS = 32_768, 256, 1 << 21
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of lower-cased word shingles, each as often as it occurs; a shorter text is one shingle, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII case and space
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], "<u8")
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(begin, end[shingle - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of lower-cased word shingles, each as often as it occurs; 0 without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 1000:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_hash"]
            )

    rows = docs.select(col(id_col).cast("long"), col(text_col).cast("string"), F.xxhash64(col(text_col)))
    return over_texts(rows, run, "doc_id long, fp long, text_hash long")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """The upper tree: splits only. Leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int, seed: int = 7):
        self.radius, self.leaves, rng = radius, 0, np.random.default_rng(seed)
        self.root = self._grow(sample, depth, rng)

    def _grow(self, points: np.ndarray, depth: int, rng):
        best = None
        if depth and len(points) > 1:
            for at in rng.choice(points, min(16, len(points)), replace=False):
                far = _distance(points, at)
                mu = int(np.median(far))
                share = (far <= mu).mean()
                both = ((far > mu - self.radius) & (far <= mu + self.radius)).mean()
                if 0 < share < 1 and (best is None or (cost := max(share, 1 - share) + both) < best[0]):
                    best = (max(share, 1 - share) + both, at, mu, far <= mu)
        if best is None:
            self.leaves += 1
            return self.leaves - 1
        _, at, mu, left = best
        return (at, mu, self._grow(points[left], depth - 1, rng), self._grow(points[~left], depth - 1, rng))

    def homes_and_visits(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf, row of fps and whether at home, for each leaf that a fingerprint lives in or visits."""
        leaf, row, home = [], [], []

        def walk(node, rows, at_home):
            if not len(rows):
                return
            if isinstance(node, int):
                leaf.append(np.full(len(rows), node, np.int32))
                row.append(rows)
                home.append(at_home)
                return
            at, mu, left, right = node
            far = _distance(fps[rows], at)
            to = far <= mu + self.radius
            walk(left, rows[to], at_home[to] & (far[to] <= mu))
            to = far > mu - self.radius
            walk(right, rows[to], at_home[to] & (far[to] > mu))

        walk(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        leaf, row, home = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (leaf, row, home))
        lives = np.zeros(len(fps), np.int64)
        lives[row[home.astype(bool)]] = leaf[home.astype(bool)]
        keep = leaf >= lives[row]
        return leaf[keep], row[keep], home[keep].astype(bool)


class Forest:
    """Union-find over rows 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        at = self.up[rows]
        while (self.up[at] != at).any():
            at = self.up[at]
        self.up[rows] = at
        return at

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        open_ = a != b
        for x, y in np.unique(np.column_stack([a[open_], b[open_]]), axis=0):
            while self.up[x] != x:
                x = self.up[x]
            while self.up[y] != y:
                y = self.up[y]
            self.up[max(x, y)] = min(x, y)


def link_within(points: np.ndarray, homes: np.ndarray, radius: int, forest: Forest, leaf: int = 128) -> None:
    """Link every point to every home within radius. homes: rows of points."""
    rng = np.random.default_rng(len(points))

    def plain(h, q):
        step = max(1, (1 << 21) // max(1, len(h)))
        for i in range(0, len(q), step):
            near = np.bitwise_count(points[q[i : i + step], None] ^ points[None, h]) <= radius
            a, b = np.nonzero(near)
            if len(a):
                forest.link(q[i + a], h[b])

    def search(h, q):
        if len(h) <= leaf or len(q) <= 4:
            return plain(h, q) if len(h) and len(q) else None
        at = points[h[rng.integers(len(h))]]
        far = _distance(points[h], at)
        mu = int(np.median(far))
        left = far <= mu
        if left.all():
            mu -= 1
            left = far <= mu
        if not left.any():
            return plain(h, q)
        off = _distance(points[q], at)
        search(h[left], q[off <= mu + radius])
        search(h[~left], q[off > mu - radius])

    search(homes, np.arange(len(points)))


def linked(fps: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(u, v): distinct fingerprints of column fp to stars of what links of at most radius bits join.

    Splits come from a sample of at most sample_rows fingerprints, of which each
    shard to be gets at least SAMPLE_PER_SHARD unless that bound is met.
    """
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    size = min(sample_rows, max(8192, SAMPLE_PER_SHARD << depth))
    sample = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).toPandas()["fp"].to_numpy("int64")
    tree = VantageTree(sample.view(np.uint64), depth, radius)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy("int64")
            leaf, row, home = tree.homes_and_visits(fp.view(np.uint64))
            yield pd.DataFrame({"shard": leaf.astype("int32"), "fp": fp[row], "home": home})

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        fp = shard["fp"].to_numpy("int64")
        forest = Forest(len(fp))
        link_within(fp.view(np.uint64), np.flatnonzero(shard["home"].to_numpy(bool)), radius, forest)
        root = forest.roots(np.arange(len(fp)))
        moved = root != np.arange(len(fp))
        return pd.DataFrame({"u": fp[moved], "v": fp[root[moved]]})

    placed = fps.select("fp").mapInPandas(place, "shard int, fp long, home boolean")
    return stars(placed.groupBy("shard").applyInPandas(search, "u long, v long"))


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    shard_rows: int = SHARD_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, fp, text_hash, component_id.

    component_id is the smallest id that links of at most `radius` differing
    bits reach, the row's own included. Null, empty and blank texts have
    fingerprint 0, which links like any other. Rows without an id get the
    component of their fingerprint, null if nobody in it has an id. Repeated
    rows share a class. No rows in: no rows out. Other columns never matter.

    Every fingerprint is placed and searched; only splits come from a sample.
    """
    thin = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(thin.groupBy("fp").agg(F.min("doc_id").alias("least")))
    star = linked(fps, radius, shard_rows, sample_rows).withColumnRenamed("u", "fp").withColumnRenamed("v", "root")
    rooted = fps.join(star, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(rooted.join(classes, "root").select("fp", "component_id", "root"))
    return thin.join(by_fp, "fp").select("doc_id", "fp", "text_hash", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class: that of its smallest id (ids before nulls), columns unchanged.

    Null, empty and blank texts are one class; repeated rows leave one, whichever; no rows in: no rows out.
    """
    return keep_first(docs, near_classes(docs, id_col, text_col, **how), id_col, text_col)


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each root in classes (doc_id, text_hash, root), as keep_one does.

    Only rows of classes with several are shuffled: a bitmap tells nearly all
    others apart where they are.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h")))
    judged = classes.groupBy("root").agg(first.alias("f"), F.count("*").alias("n"))
    kept = cut(judged.where("n > 1").select("root", F.col("f.i").alias("i"), F.col("f.h").alias("h")))
    same = cut(classes.join(kept.select("root"), "root").select(F.xxhash64("doc_id", "text_hash").alias("k")).distinct())
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).cast("long").alias("i"), F.xxhash64(col(text_col)).alias("h"))
    rows = may_be_among(rows.withColumn("k", F.xxhash64("i", "h")), same, "k", "maybe")
    alone = rows.where(~F.col("maybe")).select("row")
    shuffled = rows.where("maybe").join(same.withColumn("several", F.lit(True)), "k", "left")
    chosen = shuffled.where("several").join(
        kept.select(F.col("i").alias("fi"), F.col("h").alias("fh")),
        F.col("i").eqNullSafe(F.col("fi")) & (F.col("h") == F.col("fh")),
        "left_semi",
    )
    once = Window.partitionBy("i", "h").orderBy(F.lit(1))
    one = chosen.withColumn("n", F.row_number().over(once)).where(F.col("n") == 1).select("row")
    return alone.unionByName(shuffled.where("several is null").select("row")).unionByName(one).select("row.*")
