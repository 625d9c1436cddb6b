"""Collocations: frequent phrases by how much more often their words meet than apart.

Phrases are counted by pivot partitioning. Words are ordered from frequent to
rare, and an n-gram belongs to its rarest word, its pivot (the first, if that
word occurs in it again). Each occurrence of a word sends a fragment of the text
around it to its pivot's partition: the words before it that are more frequent
and those after it that aren't rarer, at most four each, so that the fragment
holds just the n-grams which that occurrence owns. Partitions count what they
own, and no n-gram is counted in two.

Words are told by their number in the order. The most frequent ones of those
that reach the threshold are listed in a table of bounded size that every task
holds. If all fit, other words are too rare for any phrase and break fragments.
If not, unlisted words follow all listed ones in the order of a checksum and
travel with the rows that need them.

A task groups equal fragments of a chunk of text before anything is shuffled,
which leaves little of the most frequent pivots, as their fragments have few
words to choose from. A pivot with more occurrences than a partition should hold
is dealt over several by chunk; their counts are added up natively.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, over_texts

#: Longest phrase in words; a fragment has LONGEST - 1 places on either side of its pivot.
LONGEST = 5
SIDE, WIDE = LONGEST - 1, 2 * LONGEST - 1
#: Words listed at most, and the bytes of the longest of them.
LISTED, LISTED_BYTES = 1 << 17, 64
#: Words of a chunk, occurrences that a partition should hold about, and words counted before counts leave a task.
CHUNK_WORDS, PARTITION, COUNTED = 1 << 20, 1 << 19, 1 << 18

#: A-Z in lower case; what ends a piece becomes a full stop.
_FOLD = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_LISTS: dict[str, "_Listed"] = {}


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, with full stops between its pieces."""
    return (text or b"").translate(_FOLD).replace(b".", b" . ").split()  # no other white space of ASCII is left


def _fields(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), col(text_col).cast("string").cast("binary").alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n): how often each word occurs in its language; word null: all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b".", None)
                words = [*counts, None]
                numbers = [*counts.values(), sum(counts.values())]
                columns = [pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array(numbers, pa.int64())]
                yield from pa.Table.from_arrays(columns, names=["lang", "word", "n"]).to_batches(1 << 14)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, held.values())) > COUNTED:
                yield from flush()
        yield from flush()

    counted = over_texts(_fields(docs, text_col, lang_col), count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Listed:
    """The listed words in a Python worker: numbers from 1, frequent ones first, of each language's words."""

    def __init__(self, rows: list[tuple[str, bytes, int]], complete: bool):
        self.complete, self.first_free = complete, len(rows) + 1
        self.names = [(None, None), *((lang, word) for lang, word, _ in rows)]
        self.counts = np.array([0, *(n for *_, n in rows)], np.int64)
        self.numbers: dict[str, dict[bytes, int]] = {}
        for number, (lang, word, _) in enumerate(rows, 1):
            self.numbers.setdefault(lang, {})[word] = number

    @staticmethod
    def of(shared: Broadcast, name: str) -> "_Listed":
        if name not in _LISTS:
            _LISTS.clear()
            _LISTS[name] = _Listed(*shared.value)
        return _LISTS[name]


def _encode(listed: _Listed, lang: str, words: list[bytes], others: dict[tuple[str, bytes], int]) -> np.ndarray:
    """Words as numbers, 0 between pieces; unlisted ones as others numbers them, or 0 if they are surely rare."""
    numbers = listed.numbers.get(lang, {})
    ids = np.fromiter((numbers.get(w, 0) for w in words), np.int32, len(words))
    if not listed.complete:
        for at in np.flatnonzero(ids == 0).tolist():
            if words[at] != b".":
                ids[at] = others.setdefault((lang, words[at]), listed.first_free + len(others))
    return ids


def fragments(ids: np.ndarray) -> np.ndarray:
    """(k, WIDE) numbers: each occurrence that owns an n-gram, its pivot in the middle, 0 where the fragment has ended."""
    n = len(ids)
    padded = np.concatenate((np.zeros(SIDE, ids.dtype), ids, np.zeros(SIDE, ids.dtype)))
    out = np.zeros((n, WIDE), ids.dtype)
    out[:, SIDE] = ids
    for side in (-1, 1):
        open_ = ids > 0
        for k in range(1, SIDE + 1):
            near = padded[SIDE + side * k : SIDE + side * k + n]
            open_ = open_ & (near > 0) & (near < ids if side < 0 else near <= ids)
            out[:, SIDE + side * k] = np.where(open_, near, 0)
    return out[(out[:, SIDE - 1] > 0) | (out[:, SIDE + 1] > 0)]


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of a matrix of 32-bit numbers, and how often each occurs."""
    width = 4 * rows.shape[1]
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
    seen = pc.value_counts(packed)
    values = seen.field("values")
    flat = np.frombuffer(values.buffers()[1], rows.dtype, len(values) * rows.shape[1], values.offset * width)
    return flat.reshape(-1, rows.shape[1]), seen.field("counts").to_numpy()


#: Fragments by columns, how often each occurs, and unlisted words, whose numbers begin after the listed ones.
SENT = "part int, salt int, fragments binary, times binary, langs array<string>, words array<binary>"
_NAMES = ["part", "salt", "fragments", "times", "langs", "words"]


def _send(listed: _Listed, parts: int, chunk: int, ids: np.ndarray, others: dict[tuple[str, bytes], int]) -> Iterator[pa.RecordBatch]:
    """A chunk's fragments, a row for each partition that they go to."""
    free = listed.first_free
    if others:  # number them anew in an order that all tasks share
        keys = sorted(others, key=lambda key: (crc32(key[1]), key))
        anew = np.arange(free + len(keys), dtype=np.int32)
        anew[[others[key] for key in keys]] = np.arange(free, free + len(keys), dtype=np.int32)
        ids = anew[ids]
        homes = np.array([crc32(word) % parts for _, word in keys], np.int64)
    rows, times = _grouped(fragments(ids)) if len(ids) else (np.empty((0, WIDE), np.int32), np.empty(0, np.int64))
    pivots = rows[:, SIDE].astype(np.int64)
    part, salt = pivots % parts, np.zeros(len(rows), np.int64)
    of_list = pivots < free
    salts = -(-listed.counts[pivots[of_list]] // PARTITION)
    salt[of_list] = chunk % np.maximum(salts, 1)
    if others:
        part[~of_list] = homes[pivots[~of_list] - free]
    order = np.lexsort((salt, part))
    rows, times, part, salt = rows[order], times[order], part[order], salt[order]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (np.diff(salt) != 0)))) if len(rows) else []
    out: list[list] = [[] for _ in _NAMES]
    for begin, end in zip(begins, [*begins[1:], len(rows)]):
        some, langs, words = rows[begin:end], [], []
        if others and (needed := np.unique(some[some >= free])).size:
            langs, words = map(list, zip(*(keys[i - free] for i in needed.tolist())))
            some = np.where(some >= free, free + np.searchsorted(needed, some), some).astype(np.int32)
        blobs = (pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) for x in (some.T, times[begin:end].astype(np.int32)))
        for into, value in zip(out, (int(part[begin]), int(salt[begin]), *blobs, langs, words)):
            into.append(value)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary()))
    yield from pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=_NAMES).to_batches(1 << 8)


def _owned(rows: np.ndarray, times: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of so many words that fragments own, each once, and their counts."""
    grams, counts = [], []
    for before in range(words):
        first, last = SIDE - before, SIDE - before + words - 1
        has = (rows[:, first] > 0) & (rows[:, last] > 0)
        grams.append(rows[has, first : last + 1])
        counts.append(times[has])
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    if not len(grams):
        return grams, counts
    names = [f"w{i}" for i in range(words)]
    summed = pa.table([*grams.T, counts], names=[*names, "n"]).group_by(names, use_threads=False).aggregate([("n", "sum")])
    return np.stack([summed[name].to_numpy() for name in names], 1), summed["n_sum"].to_numpy()


def _mine(listed: _Listed, sent: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, words, n) of a partition's n-grams: frequent ones, and all of pivots that other partitions hold as well."""
    free, others, blocks, times = listed.first_free, {}, [], []
    for fragment, count, langs, words in zip(*(sent[c].to_pylist() for c in _NAMES[2:])):
        n = np.frombuffer(_plain(count), np.int32)
        block = np.frombuffer(_plain(fragment), np.int32).reshape(WIDE, -1).T
        if words:
            anew = np.array([others.setdefault(key, free + len(others)) for key in zip(langs, words)], np.int32)
            block = np.where(block >= free, anew[np.maximum(block - free, 0) % len(anew)], block)
        blocks.append(block)
        times.append(n.astype(np.int64))
    rows, times = np.concatenate(blocks), np.concatenate(times)
    names = [*listed.names, *others]
    spread = np.concatenate((listed.counts > PARTITION, np.zeros(len(others), bool)))
    out: list[list] = [[], [], [], []]
    for words in range(2, LONGEST + 1):
        grams, counts = _owned(rows, times, words)
        keep = counts >= least
        if len(grams):
            keep |= spread[grams.max(1)]
        for gram, n in zip(grams[keep].tolist(), counts[keep].tolist()):
            out[0].append(names[gram[0]][0])
            out[1].append(b" ".join([names[w][1] for w in gram]))
            out[2].append(words)
            out[3].append(n)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.binary(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "n"])


def _plain(blob: bytes) -> bytes:
    return pa.input_stream(pa.BufferReader(blob), compression="zstd").read()


def frequent_phrases(docs: DataFrame, least: int = 100, text_col: str = "text", lang_col: str = "lang", listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a), (lang, n)): every phrase of 1 to LONGEST words that occurs `least` times, and the words of each language."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs, text_col, lang_col).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counts.where(F.col("word").isNull()).select("lang", "n")
    common = counts.where(F.col("word").isNotNull())
    short = common.where(F.octet_length("word") <= LISTED_BYTES)
    rows = [(r.lang, bytes(r.word), r.n) for r in short.orderBy(F.desc("n"), "lang", "word").limit(listed).collect()]
    shared = spark.sparkContext.broadcast((rows, common.count() == len(rows)))
    name = uuid.uuid4().hex
    everything = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-everything // PARTITION))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, chunk, held, size, others = _Listed.of(shared, name), TaskContext.get().partitionId(), 0, [], 0, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += [_encode(known, lang, tokens(text.as_py()), others), np.zeros(1, np.int32)]
                size += len(held[-2])
                if size >= CHUNK_WORDS:
                    yield from _send(known, parts, task + chunk, np.concatenate(held), others)
                    chunk, held, size, others = chunk + 1, [], 0, {}
        if held:
            yield from _send(known, parts, task + chunk, np.concatenate(held), others)

    def mine(sent: pa.Table) -> pa.Table:
        return _mine(_Listed.of(shared, name), sent, least)

    sent = over_texts(_fields(docs, text_col, lang_col), send, SENT)
    mined = sent.groupBy("part", "salt").applyInArrow(mine, "lang string, phrase binary, words int, n long")
    counted = mined.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    single = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))
    return single.unionByName(counted).withColumn("phrase", F.col("phrase").cast("string")), totals


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", listed: int = LISTED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words.

    Texts are lower-cased in A-Z, parted at `.,;:!?` and line ends into pieces,
    and those at spaces and tabs into words; phrases lie within pieces. a is how
    often a phrase occurs, overlaps included, n how many words its language has.
    Each cut into a first part that occurs l times and a rest that occurs r times
    gives the score floor(1000 a n / (l r)), and the lowest one counts, of equal
    ones that of the shortest first part. Phrases inside a longer one that occurs
    as often are left out, then `top` of each language stay, by score, a and
    phrase in byte order.

    Null languages are `und`, null and empty texts have no words. Copies and
    repeated rows count each. Long texts and long words are taken whole. No
    rows in, or none frequent: no rows out. Other columns never matter.
    """
    phrases, totals = frequent_phrases(docs, least, text_col, lang_col, listed)
    known = cut(phrases)
    longer = known.where("words > 2").select(
        "lang", F.explode(F.array(*[F.array_join(part, " ") for part in _ends()])).alias("phrase"), F.col("a").alias("longer_a")
    )
    longest = longer.groupBy("lang", "phrase").agg(F.max("longer_a").alias("longer_a"))
    kept = known.where("words > 1").join(longest, ["lang", "phrase"], "left").where("longer_a is null or longer_a < a").drop("longer_a")
    cuts = kept.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, words)"), " ").alias("rest")
    )
    left, right = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    # 1000 a n has at most 36 digits and l r 32, where a, l, r and n are below 10^16.
    score = F.expr("(1000BD * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = (F.desc("score"), F.desc("a"), "phrase")
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))  # a language may hold most phrases
    few = some.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _ends() -> list:
    """A phrase's words without the last, and without the first."""
    words = F.split("phrase", " ")
    return [F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1)]
