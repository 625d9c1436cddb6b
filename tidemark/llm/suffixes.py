"""Remove passages that earlier documents hold, by merging front-coded suffix runs.

A byte goes if a string of `length` bytes that covers it also starts in a
document of smaller id. Sorting every suffix would move fifty times the corpus,
so only the suffixes that can matter are exchanged:

1. Documents are packed into compressed blobs once; from here on, text moves
   only as blobs.
2. Anchors: in every window of `length` bytes the 16-byte grams of least hash
   (winnowing; Schleimer et al., 2003). Equal strings have equal anchors at
   equal offsets, so strings can be told apart from their anchors' surroundings.
3. Blobs send their anchors' hashes, sorted and delta-coded, by hash range. A
   range answers each blob with one bit per hash: does another document hold it?
4. Of the anchors that survive, blobs send the suffixes that begin there,
   sorted, front-coded against the one before and with what lies left of the
   anchor, by the same ranges; of those with equal surroundings only the one of
   least id, so that a passage in most texts comes once from each blob.
5. Each range merges its runs in a loser tree that carries longest common
   prefixes and so never compares a known prefix again. The merged order and
   its prefix lengths say for every right length, and a sort of the left sides
   for every left length, which strings are equal; the smallest id keeps its
   own, the others' starts are marked.
6. Marks return to the blobs, which cut covered bytes out.

Whole texts and all anchors take part; no group is capped, and equal strings
are compared by sorting, never in pairs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, over_texts

#: Bytes in a string, in an anchor's gram; grams in a window; bytes left of an anchor that matter.
LENGTH = 50
GRAM = 16
GRAMS = LENGTH - GRAM + 1
LEFT = GRAMS - 1
#: Raw bytes in a blob, and of the corpus per hash range.
BLOB_BYTES, RANGE_BYTES = 4 << 20, 32 << 20
#: Bits of a hash that are sent. More text needs more to keep chance survivors rare; they cost work, not results.
HASH_BITS = 48
NO_ID = np.iinfo(np.int64).max


# -- blobs ------------------------------------------------------------------


_KINDS = "?BHIQbhiq"


def _pack(**arrays) -> bytes:
    """Named arrays as one compressed string: of each its kind and shape, then its bytes, as most messages are small."""
    import zstandard

    head, body = [], []
    for x in arrays.values():
        x = np.ascontiguousarray(x)
        head.append(struct.pack(f"<BB{x.ndim}I", _KINDS.index(x.dtype.char.replace("l", "q").replace("L", "Q")), x.ndim, *x.shape))
        body.append(x.tobytes())
    raw = b"".join([bytes([len(head)]), *head, *body])
    return zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress(raw)


def _unpack(packed: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    at, shapes, out = 1, [], []
    for _ in range(raw[0]):
        kind, dims = raw[at], raw[at + 1]
        shapes.append((np.dtype(_KINDS[kind]), struct.unpack_from(f"<{dims}I", raw, at + 2)))
        at += 2 + 4 * dims
    for kind, shape in shapes:
        n = int(np.prod(shape))
        out.append(np.frombuffer(raw, kind, n, at).reshape(shape))
        at += n * kind.itemsize
    return out


def _transposed(x: np.ndarray) -> np.ndarray:
    """Bytes of equal rank together: what varies little compresses well."""
    return x.view(np.uint8).reshape(len(x), -1).T.copy() if len(x) else np.zeros((8, 0), np.uint8)


def _straight(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view(np.uint64).reshape(-1) if x.shape[1] else np.zeros(0, np.uint64)


def blobs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(blob, n_bytes, body): ids, whether null, sizes and texts of a few MB of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, texts, held
            body = _pack(
                ids=np.array([NO_ID if i is None else i for i in ids], np.int64),
                null=np.array([i is None for i in ids], bool),
                sizes=np.array(list(map(len, texts)), np.int64),
                text=np.frombuffer(b"".join(texts), np.uint8),
            )
            out = pa.RecordBatch.from_arrays(
                [pa.array([base + made], pa.int64()), pa.array([held], pa.int64()), pa.array([body], pa.binary())],
                names=["blob", "n_bytes", "body"],
            )
            made, ids, texts, held = made + 1, [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(raw)
                held += len(raw)
                if held >= BLOB_BYTES or len(ids) >= 1 << 16:
                    yield flush()
        if ids:
            yield flush()

    return over_texts(docs.select(col(id_col).cast("long"), col(text_col).cast("string")), run, "blob long, n_bytes long, body binary")


# -- anchors ----------------------------------------------------------------


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of every `width` neighbours."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a blob's anchors, and their grams' 64-bit hashes."""
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = text.astype(np.uint32) + np.uint32(1)
    size, step = 1, 0x9E3779B1
    while size < GRAM:
        h = h[:-size] * np.uint32(step) + h[size:]
        step = step * step & 0xFFFFFFFF
        size *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    h |= np.uint32(1)  # 0 stands for a window that no document holds whole
    least = _sliding(h, GRAMS, np.minimum)
    ends = np.cumsum(sizes)
    for begin, end in zip(ends - sizes, ends):  # windows that would cross into the next document
        least[max(begin, end - LENGTH + 1) : end] = 0
    reach = np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(LEFT, np.uint32)])
    at = np.flatnonzero(_sliding(reach, GRAMS, np.maximum) == h)
    words = np.lib.stride_tricks.sliding_window_view(text, GRAM)[at].view("<u8").reshape(-1, 2)
    mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed = (mixed + words[:, 1]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    return at, mixed


class Blob:
    """An opened blob and its anchors, in the order of their hashes."""

    def __init__(self, body: bytes, with_anchors: bool = True):
        self.ids, self.null, self.sizes, self.text = _unpack(body)
        self.ends = np.cumsum(self.sizes)
        if with_anchors:
            at, hashes = anchors(self.text, self.sizes)
            hashes >>= np.uint64(64 - HASH_BITS)
            order = np.argsort(hashes, kind="stable")
            self.at, self.hash = at[order], hashes[order]
            self.first = np.flatnonzero(np.concatenate([[True], self.hash[1:] != self.hash[:-1]])) if len(at) else at
            self.doc = np.searchsorted(self.ends, self.at, "right")

    def ranges(self, n: int) -> np.ndarray:
        """Where each hash range begins among the distinct hashes."""
        limits = (np.arange(n + 1, dtype=np.float64) * 2.0**HASH_BITS / n).astype(np.uint64)
        cuts = np.searchsorted(self.hash[self.first], limits)
        cuts[-1] = len(self.first)
        return cuts


def hash_runs(packed: DataFrame, n_ranges: int) -> DataFrame:
    """(part, blob, body): a blob's distinct hashes of a range, and which of them two of its ids hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch["blob"], batch["body"]):
                b = Blob(body)
                if not len(b.at):
                    continue
                distinct, ids = b.hash[b.first], b.ids[b.doc]
                shared = np.minimum.reduceat(ids, b.first) != np.maximum.reduceat(ids, b.first)
                cuts = b.ranges(n_ranges)
                rows = []
                for part, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if i < j:
                        steps = np.diff(distinct[i:j], prepend=np.uint64(0))
                        rows.append((part, name, _pack(steps=_transposed(steps), shared=np.packbits(shared[i:j]))))
                yield pd.DataFrame(rows, columns=["part", "blob", "body"])

    return packed.mapInPandas(run, "part int, blob long, body binary")


def _survivors(runs: pd.DataFrame) -> pd.DataFrame:
    """For each blob of a range, one bit per hash: held by two documents?"""
    hashes, shared = [], []
    for body in runs["body"]:
        steps, bits = _unpack(body)
        hashes.append(np.cumsum(_straight(steps)))
        shared.append(np.unpackbits(bits, count=len(hashes[-1])).astype(bool))
    sizes = np.array(list(map(len, hashes)))
    every, keep = np.concatenate(hashes), np.concatenate(shared)
    order = np.argsort(every, kind="stable")
    inorder = every[order]
    same = inorder[1:] == inorder[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    keep[order[twice]] = True
    ends = np.cumsum(sizes)
    bits = [np.packbits(keep[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
    return pd.DataFrame({"blob": runs["blob"], "part": runs["part"], "bits": bits})


# -- suffix runs ------------------------------------------------------------


def _neighbour_prefix(rows: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row (bytes) with the row before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    found = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[0], found])


def _around(b: Blob, at: np.ndarray, doc: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """LENGTH bytes from each anchor on, or the LEFT before it backwards, in its document; zeros beyond, and the size."""
    begin, end = (b.ends - b.sizes)[doc], b.ends[doc]
    if right:
        size = np.minimum(LENGTH, end - at)
        where = at[:, None] + np.arange(LENGTH)
        keep = np.arange(LENGTH) < size[:, None]
    else:
        size = np.minimum(LEFT, at - begin)
        where = at[:, None] - 1 - np.arange(LEFT)
        keep = np.arange(LEFT) < size[:, None]
    out = b.text[np.clip(where, 0, len(b.text) - 1)]
    out[~keep] = 0
    return out, size.astype(np.uint8)


def suffix_runs(judged: DataFrame, n_ranges: int) -> DataFrame:
    """(part, blob, body): a blob's surviving suffixes of a range, sorted and front-coded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body, answers in zip(batch["blob"], batch["body"], batch["answers"]):
                b = Blob(body)
                cuts, rows = b.ranges(n_ranges), []
                sizes = np.diff(np.append(b.first, len(b.at)))
                for answer in answers:
                    part, i, j = answer["part"], cuts[answer["part"]], cuts[answer["part"] + 1]
                    kept = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=j - i).astype(bool)
                    if not kept.any():
                        continue
                    of = slice(b.first[i], b.first[j] if j < len(b.first) else len(b.at))
                    chosen = np.repeat(kept, sizes[i:j])
                    rows.append((part, name, _front_coded(b, b.at[of][chosen], b.doc[of][chosen])))
                yield pd.DataFrame(rows, columns=["part", "blob", "body"])

    return judged.mapInPandas(run, "part int, blob long, body binary")


def _front_coded(b: Blob, at: np.ndarray, doc: np.ndarray) -> bytes:
    """Sorted suffixes, and of each distinct surrounding the entry of least id alone.

    A blob's other entries with the same bytes around them are listed by place,
    and whether their id is larger: what holds for the least decides on them.
    """
    suffix, right = _around(b, at, doc, True)
    order = np.argsort(suffix.view(f"S{LENGTH}").reshape(-1), kind="stable")
    suffix, right, at, doc = suffix[order], right[order], at[order], doc[order]
    left, before = _around(b, at, doc, False)
    prefix, ids = _neighbour_prefix(suffix), b.ids[doc]
    distinct = (prefix < LENGTH) | (np.arange(len(at)) == 0)
    of = np.cumsum(distinct)
    order = np.lexsort((at, ids, right, before, left.view(f"S{LEFT}").reshape(-1), of))
    left, right, before, ids, at, of = left[order], right[order], before[order], ids[order], at[order], of[order]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (right[1:] != right[:-1]) | (before[1:] != before[:-1]) | (left[1:] != left[:-1]).any(1)
    first = np.flatnonzero(new)
    least = np.repeat(ids[first], np.diff(np.append(first, len(at))))
    fresh = np.flatnonzero(distinct)
    rest = np.arange(LENGTH) >= prefix[fresh, None]
    return _pack(
        prefix=prefix[fresh].astype(np.uint8),
        copies=np.bincount(of[first] - 1, minlength=len(fresh)).astype(np.uint32),
        rest=suffix[fresh][rest],
        right=right[first],
        before=before[first],
        left=left[first],
        ids=ids[first],
        at=at[first].astype(np.uint32),
        same=(np.diff(np.append(first, len(at))) - 1).astype(np.uint32),
        same_at=at[~new].astype(np.uint32),
        same_later=(ids > least)[~new],
    )


# -- merging ----------------------------------------------------------------


def _decoded(prefix: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for p in prefix.tolist():
        to = at + LENGTH - p
        last = last[:p] + rest[at:to]
        out.append(last)
        at = to
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of equally long strings, each with its prefix lengths.

    Returns, in merged order, run, position in the run, and the longest common
    prefix with the string before. It is a loser tree in which every waiting
    string knows its common prefix with the string that last went out: whoever
    shares more of it is smaller, and only equals are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1] for r in runs] + [[]] * (k - len(runs))
    now = [s[0] if s else b"" for s in strings]
    known = [0 if s else -1 for s in strings]  # -1: this run is used up
    place = [0] * k
    tree = [0] * k

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns its prefix shared with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = now[a][x:], now[b][x:]
        if s == t:
            known[b] = x + len(s)
            return a, b
        same = x + len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
        if s < t:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    out_run, out_at, out_share = [], [], []
    while known[winner] >= 0:
        at = place[winner]
        out_run.append(winner)
        out_at.append(at)
        out_share.append(known[winner])
        at += 1
        if at < len(strings[winner]):
            place[winner], now[winner], known[winner] = at, strings[winner][at], shares[winner][at]
        else:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = tree[node]
            x, y = known[winner], known[other]
            if x < y:
                tree[node], winner = winner, other
            elif x == y and x >= 0:
                s, t = now[winner][x:], now[other][x:]
                if s == t:
                    known[other] = x + len(s)
                else:
                    same = x + len(s) - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) // 8
                    if s < t:
                        known[other] = same
                    else:
                        known[winner] = same
                        tree[node], winner = winner, other
            node >>= 1
    return out_run, out_at, out_share


def _classes(sorted_prefix: np.ndarray, depth: int) -> np.ndarray:
    """Rows in order share a class while their common prefix is at least that deep."""
    return np.cumsum(sorted_prefix < depth)


def _marks(runs: pd.DataFrame) -> pd.DataFrame:
    """For each blob of a range: anchors, and in a mask which starts left of each are held earlier."""
    opened = [_unpack(body) for body in runs["body"]]
    coded = [(_decoded(x[0], x[2].tobytes()), x[0].tolist()) for x in opened]
    out_run, out_at, out_share = (np.array(x, np.int64) for x in merge_runs(coded))
    del coded
    firsts = [np.concatenate([[0], np.cumsum(x[1], dtype=np.int64)]) for x in opened]
    base = np.concatenate([[0], np.cumsum([f[-1] for f in firsts])])
    starts = np.concatenate([f[:-1] + b for f, b in zip(firsts, base)])
    copies = np.concatenate([x[1] for x in opened]).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum([len(x[1]) for x in opened])])
    row = offset[out_run] + out_at
    n_each = copies[row]
    begins = np.cumsum(n_each) - n_each
    entry = np.repeat(starts[row] - begins, n_each) + np.arange(n_each.sum())
    prefix = np.full(len(entry), LENGTH, np.int64)
    prefix[begins] = out_share
    right, before, left, ids, at, same = (np.concatenate([x[i] for x in opened])[entry] for i in (3, 4, 5, 6, 7, 8))
    blob = np.repeat(runs["blob"].to_numpy("int64"), np.diff(base))[entry]
    same = same.astype(np.int64)
    listed = np.cumsum(np.concatenate([x[8] for x in opened]).astype(np.int64))[entry] - same  # where each entry's list begins
    same_at, same_later = (np.concatenate([x[i] for x in opened]) for i in (9, 10))
    del opened

    order = np.argsort(np.ascontiguousarray(left).view(f"S{LEFT}").reshape(-1), kind="stable")
    left_prefix = _neighbour_prefix(left[order])
    del left
    mask, whole = np.zeros(len(entry), np.uint64), np.zeros(len(entry), np.uint64)
    left_class = np.empty(len(entry), np.int64)
    for o in range(GRAMS):
        left_class[order] = _classes(left_prefix, o)
        ok = np.flatnonzero((right >= LENGTH - o) & (before >= o))
        if not len(ok):
            continue
        whole[ok] |= np.uint64(1 << o)
        key = _classes(prefix, LENGTH - o)[ok] * (len(entry) + 1) + left_class[ok]
        by = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        least = np.minimum.reduceat(ids[ok][by], np.flatnonzero(new))
        later = ids[ok][by] > least[np.cumsum(new) - 1]
        mask[ok[by[later]]] |= np.uint64(1 << o)
    # entries of larger id than the least with the same surroundings in their blob are held earlier by that one
    place = np.repeat(listed - (np.cumsum(same) - same), same) + np.arange(same.sum())
    also = np.where(same_later[place], np.repeat(whole, same), np.repeat(mask, same))
    blob, at, mask = np.concatenate([blob, np.repeat(blob, same)]), np.concatenate([at, same_at[place]]), np.concatenate([mask, also])
    hit = np.flatnonzero(mask)
    hit = hit[np.lexsort((at[hit], blob[hit]))]
    names, first = np.unique(blob[hit], return_index=True)
    bodies = [_pack(at=at[h], mask=mask[h]) for h in np.split(hit, first[1:])] if len(hit) else []
    return pd.DataFrame({"blob": names.astype("int64"), "marks": bodies})


def _cleaned(body: bytes, marks: list[bytes]) -> list[tuple]:
    """Id, size, bytes and runs removed, and what is kept, of each document."""
    b = Blob(body, with_anchors=False)
    change = np.zeros(len(b.text) + LENGTH + 1, np.int32)
    start = np.zeros(len(b.text) + 1, bool)
    for packed in marks:
        at, mask = _unpack(packed)
        at = at.astype(np.int64)
        for o in range(GRAMS):
            start[at[(mask >> np.uint64(o)) & np.uint64(1) == 1] - o] = True
    p = np.flatnonzero(start)
    change[p] += 1
    change[p + LENGTH] -= 1
    gone = np.cumsum(change[: len(b.text)]) > 0
    rows = []
    for i, null, end, size in zip(b.ids.tolist(), b.null.tolist(), b.ends.tolist(), b.sizes.tolist()):
        cut_, text = gone[end - size : end], b.text[end - size : end]
        n = int(cut_.sum())
        spans = int(cut_[0]) + int((cut_[1:] & ~cut_[:-1]).sum()) if n else 0
        kept = (text[~cut_] if n else text).tobytes()
        rows.append((None if null else i, size, n, spans, kept))
    return rows


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is kept, for every row of docs.

    `kept` holds the remaining UTF-8 bytes or, with digest, kept_sha256 their
    lower-case hex digest, taken where the text is so that it needn't travel.

    Null and empty texts have 0 bytes. Texts under LENGTH bytes lose nothing.
    Rows without an id come after all others and lose nothing to one another;
    nor do rows that repeat an id. Matches never cross documents and are judged
    on the input. No rows in: no rows out. Other columns never matter.
    """
    packed = cut(blobs(docs, id_col, text_col))
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    n_ranges = max(1, -(-total // RANGE_BYTES))
    bits = (
        hash_runs(packed, n_ranges)
        .groupBy("part")
        .applyInPandas(_survivors, "blob long, part int, bits binary")
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("answers"))
    )
    marks = cut(
        suffix_runs(packed.select("blob", "body").join(bits, "blob"), n_ranges)
        .groupBy("part")
        .applyInPandas(_marks, "blob long, marks binary")
    )
    by_blob = marks.groupBy("blob").agg(F.collect_list("marks").alias("marks"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, held in zip(batch.column(0), batch.column(1)):
                ids, sizes, removed, spans, kept = zip(*_cleaned(body.as_py(), held.as_py() or []))
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, long), pa.array(sizes, long), pa.array(removed, long), pa.array(spans, long), last],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
                )

    end = "kept_sha256 string" if digest else "kept binary"
    return (
        packed.join(by_blob, "blob", "left")
        .select("body", "marks")
        .mapInArrow(clean, f"doc_id long, n_bytes long, n_removed long, n_spans long, {end}")
    )
