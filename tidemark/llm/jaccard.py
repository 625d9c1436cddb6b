"""Near-duplicates by word shingles: SimHash links first, then every other pair of that similarity.

A text is the set of its shingles' hashes; equal sets are one. Links come from

1. SimHash: fingerprints within `radius` bits, found by the vantage-point tree
   of simhash.py, if the sets are as similar as asked. This joins most copies.
2. Prefix filtering, which loses no pair, where fingerprints within any radius
   lose some: if two sets have a similarity of at least t, then in any fixed
   order of all shingles their first n - ceil(t n) + 1 share one. The order puts
   shingles rare in a bounded sample first; it has no influence on the result.
   Sets that share one and aren't linked yet are compared with their group's
   least, then its greatest, then with each other: small groups in sorted runs,
   of which what passes the sketch leaves a task, large ones block against
   block, of which a forest of what is linked leaves, never pairs.

Of each pair a sketch of the sets, the parities of how many hashes fall on each
of SKETCH_BITS or more places, bounds from below in how many shingles they differ; only
pairs within the bound are compared as whole sets, and only texts of such pairs
are shuffled, as sets of SET_BYTES a shingle. Connected components give classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, may_be_among, over_texts
from .components import stars
from .simhash import Forest, fingerprint_of, keep_first, linked, shingle_hashes

#: Shingles of the sample whose frequency the order knows, the most frequent ones.
KNOWN_SHINGLES = 200_000
SKETCH_BITS = 1024
#: Bytes of each hash that whole sets are compared by: two shingles of a pair of long texts fall together once in a million pairs.
SET_BYTES = 5
#: Members of a group that are compared in sorted runs, and of a block of a larger one.
SMALL_GROUP, BLOCK = 48, 4096


def _frequent(texts: DataFrame, shingle: int, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several texts of a sample hold, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(0)]
            if sets:
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view("<i8")), pa.array(n, pa.int64())], names=["s", "n"])

    one_in = max(1, texts.count() // sample_rows)
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).distinct()
    some = over_texts(some, run, "s long, n long")
    counted = some.groupBy("s").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(KNOWN_SHINGLES).toPandas()
    s, n = counted["s"].to_numpy("int64").view(np.uint64), counted["n"].to_numpy("int64")
    order = np.argsort(s)
    return s[order], n[order]


def _sketch(hashes: np.ndarray) -> bytes:
    """Parities at SKETCH_BITS places, doubled until there are two for each hash."""
    bits = SKETCH_BITS
    while bits < 2 * len(hashes):
        bits *= 2
    counts = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _differ(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which sketches differ, pair by pair. The longer of two is folded: parities of places that fall together add up."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
    for la, lb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (la, lb)).all(1))
        x, y = (np.frombuffer(b"".join([t[i] for i in at]), np.uint64).reshape(len(at), -1) for t in (a, b))
        while x.shape[1] != y.shape[1]:
            if x.shape[1] > y.shape[1]:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            else:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def _packed(hashes: np.ndarray) -> bytes:
    """The low SET_BYTES of each hash, distinct and in order."""
    low = np.unique(hashes & np.uint64((1 << 8 * SET_BYTES) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def _opened(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").reshape(-1)


def _joined(pairs: DataFrame, sets: DataFrame, *names: str) -> DataFrame:
    """Pairs (u, v) with the named columns of both sets, _a and _b."""
    for k, end in (("u", "a"), ("v", "b")):
        pairs = pairs.join(sets.select(F.col("set_id").alias(k), *[F.col(n).alias(f"{n}_{end}") for n in names]), k)
    return pairs.select("u", "v", *[f"{n}_{end}" for n in names for end in "ab"])


def within_bound(n: np.ndarray, m: np.ndarray, differ: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m elements that differ in at least so many may be so similar."""
    ok = differ <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6
    return ok & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


def _may_be_alike(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that sizes and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            keep = within_bound(n, m, _differ(batch.column(4).to_pylist(), batch.column(5).to_pylist()), similarity)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep))

    # sizes rule out most, before sketches are sent
    near = _joined(pairs, sketches, "n").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    return cut(_joined(near.select("u", "v"), sketches, "n", "sketch").mapInArrow(run, "u long, v long"))


def _in_runs(small: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) within groups (s, set_id, r, m, c) of at most SMALL_GROUP that have to meet and that sketches don't rule out.

    Groups lie sorted in their task, and every row meets the rows up to
    SMALL_GROUP - 1 places on, as far as its group goes; only what passes leaves.
    """
    rows = small.join(sketches.select("set_id", "n", "sketch"), "set_id").repartition("s").sortWithinPartitions("s")

    def met(t: pa.Table) -> pa.RecordBatch:
        s, ids, r, c, n = (t.column(i).to_numpy() for i in range(5))
        sketch, out = np.array(t.column(5).to_pylist() + [b""], object)[:-1], []
        for step in range(1, SMALL_GROUP):
            a = np.flatnonzero(s[step:] == s[:-step]) if step < len(s) else np.zeros(0, np.int64)
            if not len(a):
                break
            b = a + step
            ok = (r[a] != r[b]) & ((c[a] != c[b]) | (c[a] == s[a])) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6)
            a, b = a[ok], b[ok]
            if len(a):
                keep = within_bound(n[a], n[b], _differ(sketch[a].tolist(), sketch[b].tolist()), similarity)
                out.append((ids[a[keep]], ids[b[keep]]))
        u, v = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows whose group may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
            if not t.num_rows:
                continue
            s = t.column(0).to_numpy()
            whole = int(np.searchsorted(s, s[-1], "left"))
            yield met(t.slice(0, whole).combine_chunks())
            held = t.slice(whole)
        if held is not None:
            yield met(held.combine_chunks())

    return over_texts(rows.select("s", "set_id", "r", "c", "n", "sketch"), run, "u long, v long")


def _in_blocks(coloured: DataFrame, sketches: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Links (u, v) within groups (s, set_id, r, m, c) that have to meet: block against block.

    First as sketches, which tell whose sets are needed, then these as sets.

    Of each group the larger one of its largest root r and its largest colour c
    stays apart: its blocks meet only the others'. A task returns a forest of
    what it has linked, never pairs.
    """
    largest = lambda of, n: F.struct(F.max_by(of, F.struct(n, of)).alias("k"), F.max(n).alias("n"))
    by_root = coloured.groupBy("s", "r").agg(F.count("*").alias("n")).groupBy("s").agg(largest("r", "n").alias("root"))
    by_colour = coloured.where("c <> s").groupBy("s", "c").agg(F.count("*").alias("n")).groupBy("s").agg(largest("c", "n").alias("colour"))
    apart = by_root.join(by_colour, "s", "left").select(
        "s", "root", "colour", (F.col("root.n") >= F.coalesce("colour.n", F.lit(0))).alias("by_root")
    )
    sides = coloured.join(apart, "s").select(
        "s", "set_id", "r", "c",
        F.when(F.col("by_root"), F.col("r") == F.col("root.k")).otherwise(F.col("c") == F.col("colour.k")).alias("aside"),
        F.ceil(F.when(F.col("by_root"), F.col("root.n")).otherwise(F.col("colour.n")) / BLOCK).cast("int").alias("kept"),
        F.ceil((F.col("m") - F.when(F.col("by_root"), F.col("root.n")).otherwise(F.col("colour.n"))) / BLOCK).cast("int").alias("others"),
    )
    place = F.xxhash64("set_id")
    dealt = (
        sides.where("others > 0")
        .withColumn("own", F.when(F.col("aside"), F.pmod(place, F.col("kept"))).otherwise(F.col("kept") + F.pmod(place, F.col("others"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(F.col("aside"), F.col("kept")).otherwise(0), F.col("kept") + F.col("others") - 1)))
        .select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "r", "c")
    )
    dealt = cut(dealt)

    def candidates(g: pd.DataFrame, n: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Rows, and the rows each has to meet that its sketch doesn't rule out."""
        r, c, own = (g[name].to_numpy() for name in ("r", "c", "own"))
        sketch = np.array([*sketches, b""], object)[:-1]
        s, i, j = g["s"].iloc[0], int(g["i"].iloc[0]), int(g["j"].iloc[0])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for a in left:
            b = right[right > a] if i == j else right
            b = b[(r[b] != r[a]) & ((c[b] != c[a]) | (c[a] == s))]
            b = b[np.minimum(n[b], n[a]) >= similarity * np.maximum(n[b], n[a]) - 1e-6]
            if len(b):
                yield a, b[within_bound(n[b], n[a], _differ([sketch[a]] * len(b), sketch[b].tolist()), similarity)]

    def needed(g: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(g), bool)
        for a, b in candidates(g, g["n"].to_numpy(), g["sketch"].tolist()):
            hit[b] = True
            hit[a] |= len(b) > 0
        return pd.DataFrame({"set_id": g["set_id"].to_numpy()[hit]})

    def search(g: pd.DataFrame) -> pd.DataFrame:
        ids, opened, found = g["set_id"].to_numpy(), [_opened(x) for x in g["set"]], []
        forest = Forest(len(g))
        for a, b in candidates(g, np.array(list(map(len, opened))), [_sketch(x << np.uint64(40)) for x in opened]):
            for x in b:
                pair = np.array([a, x])
                root_a, root_x = forest.roots(pair)
                if root_a != root_x and similar(opened[a], opened[x]) >= similarity:
                    forest.link(pair[:1], pair[1:])
                    found.append((ids[a], ids[x]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    sketched = dealt.join(sketches.select("set_id", "n", "sketch"), "set_id")
    few = cut(sketched.groupBy("s", "i", "j").applyInPandas(needed, "set_id long").distinct())
    whole = dealt.join(sets_of(few).select("set_id", "set"), "set_id")
    return cut(whole.groupBy("s", "i", "j").applyInPandas(search, "u long, v long").distinct())


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets, each distinct and in order."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _alike(pairs: DataFrame, sets, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are so similar. sets: gives the whole sets of the ids in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(_opened(a.as_py()), _opened(b.as_py())) >= similarity for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    asked = cut(pairs.select(F.col("u").alias("set_id")).unionByName(pairs.select(F.col("v").alias("set_id"))).distinct())
    return cut(over_texts(_joined(pairs, sets(asked), "set"), run, "u long, v long"))


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 3,
    sample_rows: int = 10_000,
) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, root.

    Rows share a root if links of at least `similarity` join them. Null, empty
    and blank texts are alike. No rows in: no rows out. Ties and repeated rows
    share a root; other columns never matter.
    """
    import xxhash

    texts = docs.select(col(text_col).cast("string").alias("text"))
    known, often = _frequent(texts, shingle, sample_rows)

    def first_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # sets whose sketch and part this task has given
        for batch in batches:
            if len(told) > 1_000_000:
                told.clear()
            ids, fps, sizes, sketches, parts = [], [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                s = np.unique(hashes)
                ids.append(name := xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                fps.append(fingerprint_of(hashes))
                sizes.append(n := len(s))
                if name in told:
                    sketches.append(None)
                    parts.append(None)
                    continue
                told.add(name)
                sketches.append(_sketch(s))
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, often[at], 0), kind="stable")]
                parts.append(s[: n - ceil(similarity * n - 1e-9) + 1].view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(parts, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "set_id", "fp", "n", "sketch", "part"],
            )

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), F.xxhash64(col(text_col)).alias("h"))
    seen = cut(over_texts(rows, first_parts, "doc_id long, text_hash long, set_id long, fp long, n int, sketch binary, part array<long>"))
    parts = seen.where(F.col("part").isNotNull()).select(F.explode("part").alias("s"), "set_id").repartition("s")
    groups = parts.groupBy("s").agg(F.min("set_id").alias("least"), F.max("set_id").alias("greatest")).where("least < greatest")
    shared = cut(parts.join(groups, "s").distinct())
    by_fp = cut(seen.groupBy("fp", "set_id").agg(F.lit(1)).groupBy("fp").agg(F.min("set_id").alias("least")))
    near = linked(by_fp, radius)
    reps = by_fp.select(F.col("fp").alias("u"), F.col("least").alias("a")).join(near, "u")
    reps = reps.join(by_fp.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same_fp = seen.select("fp", "set_id").distinct().join(by_fp, "fp").where("set_id <> least").select(F.col("set_id").alias("u"), F.col("least").alias("v"))
    by_simhash = cut(reps.unionByName(same_fp).where("u <> v").distinct())

    asked = shared.select("set_id").unionByName(by_simhash.select(F.explode(F.array("u", "v")).alias("set_id"))).distinct()
    sketches = cut(
        seen.where(F.col("sketch").isNotNull()).join(asked, "set_id", "left_semi")
        .groupBy("set_id").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            if len(told) > 1_000_000:
                told.clear()
            names, sets = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h not in told:
                    told.add(h)
                    names.append(h)
                    sets.append(_packed(shingle_hashes(text.as_py(), shingle)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["h", "set"])

    def sets_of(asked: DataFrame) -> DataFrame:
        of_set = cut(sketches.join(asked, "set_id").select("set_id", F.col("text_hash").alias("h")))
        rows = docs.select(F.xxhash64(col(text_col)).alias("h"), col(text_col).cast("string").alias("text"))
        few = over_texts(may_be_among(rows, of_set, "h", "maybe").where("maybe").select("h", "text"), whole, "h long, set binary")
        return cut(of_set.join(few, "h").groupBy("set_id").agg(F.first("set").alias("set")))

    def compared(pairs: DataFrame) -> DataFrame:
        return _alike(_may_be_alike(pairs, sketches, similarity), sets_of, similarity)

    def root(links: DataFrame, *names: str) -> list[DataFrame]:
        star = cut(stars(links))
        return [star.select(F.col("u").alias(k), F.col("v").alias(f"{k}_root")) for k in names]

    links = compared(by_simhash)
    for pivot in ("least", "greatest"):
        pairs = shared.where(F.col("set_id") != F.col(pivot)).select(F.col("set_id").alias("u"), F.col(pivot).alias("v")).distinct()
        of_u, of_v = root(links, "u", "v")
        apart = pairs.join(of_u, "u", "left").join(of_v, "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v"))
        links = links.unionByName(compared(apart.select("u", "v")))

    (of_set,) = root(links, "set_id")
    rooted = shared.join(of_set, "set_id", "left").select("s", "set_id", F.coalesce("set_id_root", "set_id").alias("r"))
    split = rooted.groupBy("s").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("m")).where("a < b").select("s", "m")
    left = rooted.join(split, "s")
    # A passage that several texts hold makes many groups of nearly the same members. A member's colour is its smallest
    # group; two members of one colour meet there and needn't meet in other groups, so a group of one other colour is done.
    colour = left.groupBy("set_id").agg(F.min(F.struct("m", "s")).alias("c")).select("set_id", F.col("c.s").alias("c"))
    left = cut(left.join(colour, "set_id"))
    mixed = left.groupBy("s").agg(F.min("c").alias("p"), F.max("c").alias("q")).where((F.col("p") != F.col("q")) | (F.col("p") == F.col("s")))
    left = cut(left.join(mixed.select("s"), "s"))
    near = cut(_in_runs(left.where(F.col("m") <= SMALL_GROUP), sketches, similarity).distinct())
    links = links.unionByName(_alike(near, sets_of, similarity))
    large = left.where(F.col("m") > SMALL_GROUP)
    links = links.unionByName(_in_blocks(large, sketches, sets_of, similarity))

    star = stars(links).select(F.col("u").alias("set_id"), F.col("v").alias("r"))
    return seen.join(star, "set_id", "left").select("doc_id", "text_hash", F.coalesce("r", "set_id").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class: that of its smallest id (ids before nulls), columns unchanged.

    Null, empty and blank texts are one class; repeated rows leave one; no rows in: no rows out.
    """
    return keep_first(docs, similar_classes(docs, id_col, text_col, **how), id_col, text_col)
