"""Periodic runs of words, by Lyndon words under both orders.

A run is a stretch of consecutive words whose smallest period is q, at least
`power` periods and `least` words long, that no neighbouring word extends. Every
run holds a Lyndon word of length q under the order of words or its reverse, and
that is the longest Lyndon word at its start. A stack scanned from right to left
finds those longest words; each is extended both ways, which gives every run and
its smallest period. Suffixes are compared and stretches extended by the longest
common extension: a few words directly, then binary search over rolling hashes,
whose answer is held against the words themselves.

A run's words lie in stretches where each three words in a row come again in
their text, so only such stretches are scanned (runs lie in them whole, and what
is maximal there is maximal in the text). Hashes find them; a collision makes a
stretch longer, never shorter.

It is one pass over the scan, without any shuffle. A task holds one batch of
texts and of its longest text some numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, over_texts

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"

#: The rolling hash: modulus below 2^31, so that products fit unsigned 64-bit numbers, and base.
MODULUS, BASE = (1 << 31) - 1, 1_000_003
#: Words compared one by one before hashes are, and the shortest match worth remembering.
DIRECT = 12


class _Extensions:
    """Longest common extensions of a sequence of numbers to the right and to the left."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.words, self.n = ids, ids.tolist(), len(ids)
        self.sums: list[int] | None = None
        #: By distance, the latest stretch [begin, end) whose words equal those at that distance, maximal both ways.
        self.known: dict[int, tuple[int, int]] = {}

    def _prepare(self) -> None:
        powers = np.ones(self.n + 1, np.uint64)
        done, step = 1, BASE
        while done <= self.n:  # powers by doubling
            more = min(done, self.n + 1 - done)
            powers[done : done + more] = powers[:more] * np.uint64(step) % np.uint64(MODULUS)
            done, step = done + more, step * step % MODULUS
        terms = (self.ids.astype(np.uint64) + np.uint64(1)) * powers[:-1] % np.uint64(MODULUS)
        self.sums = [0, *(np.cumsum(terms) % np.uint64(MODULUS)).tolist()]
        self.powers = powers.tolist()

    def _alike(self, i: int, j: int, length: int) -> bool:
        """By hash: words [i, i + length) and [j, j + length), i < j. False is certain."""
        sums = self.sums
        left = (sums[i + length] - sums[i]) * self.powers[j - i]
        return (left - sums[j + length] + sums[j]) % MODULUS == 0

    def right(self, i: int, j: int) -> int:
        """Words equal from i and from j on, i < j."""
        held = self.known.get(j - i)
        if held and held[0] <= i <= held[1]:
            return held[1] - i
        words, most, k = self.words, self.n - j, 0
        few = min(most, DIRECT)
        while k < few and words[i + k] == words[j + k]:
            k += 1
        if k < few or k == most:
            if k >= DIRECT:
                self._keep(i, j, k)
            return k
        k = self._search(k, most, lambda m: self._alike(i, j, m), lambda m: self.ids[i : i + m] != self.ids[j : j + m])
        self._keep(i, j, k)
        return k

    def left(self, i: int, j: int) -> int:
        """Words equal up to and with i and j, i < j."""
        held = self.known.get(j - i)
        if held and held[0] <= i < held[1]:
            return i + 1 - held[0]
        words, most, k = self.words, i + 1, 0
        few = min(most, DIRECT)
        while k < few and words[i - k] == words[j - k]:
            k += 1
        if k < few or k == most:
            return k
        return self._search(
            k, most, lambda m: self._alike(i + 1 - m, j + 1 - m, m), lambda m: (self.ids[i + 1 - m : i + 1] != self.ids[j + 1 - m : j + 1])[::-1]
        )

    def _search(self, low: int, most: int, alike, differs) -> int:
        """The largest m with alike(m), which low is known to be, by doubling and halving; then word by word."""
        if self.sums is None:
            self._prepare()
        high = low
        while high < most and alike(min(most, 2 * high)):
            high = min(most, 2 * high)
        low, high = high, min(most, 2 * high) if high < most else most
        while low < high:
            middle = (low + high + 1) // 2
            if alike(middle):
                low = middle
            else:
                high = middle - 1
        wrong = differs(low)
        return int(wrong.argmax()) if wrong.any() else low

    def _keep(self, i: int, j: int, k: int) -> None:
        self.known[j - i] = (i - (self.left(i - 1, j - 1) if i else 0), i + k)


def find_runs(ids: np.ndarray, least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    n, both = len(ids), _Extensions(ids)
    right, found = both.right, {}
    for sign in (1, -1):
        words = both.words if sign == 1 else [-w for w in both.words]
        smaller = [n] * (n + 1)  # the next suffix that is smaller; the end is smaller than all
        reached: dict[int, int] = {}  # by period, the start of the stretch found last
        for i in range(n - 1, -1, -1):
            word, j = words[i], i + 1
            while j < n:
                other = words[j]
                if other < word:
                    break
                if other == word:
                    k = right(i, j)
                    if j + k == n or words[j + k] < words[i + k]:
                        break
                j = smaller[j]
            smaller[i] = j
            period = j - i  # of the longest Lyndon word at i
            far = i + (power - 1) * period
            if far < n and words[far] == word and words[j] == word and i < reached.get(period, n):
                start, end = i - (both.left(i - 1, j - 1) if i else 0), j + right(i, j)
                reached[period] = start
                if end - start >= max(least, power * period):
                    found[start, period] = end - start
    return sorted((start, length, period) for (start, period), length in found.items())


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(begin, end) of each longest stretch in which every three words in a row come again somewhere in the text."""
    n = len(words) - 2
    if n < 2:
        return []
    key = np.fromiter(map(hash, words), np.int64, n + 2).view(np.uint64)
    with np.errstate(over="ignore"):
        grams = key[:-2] * np.uint64(0x9E3779B97F4A7C15) + key[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + key[2:] * np.uint64(0x165667B19E3779F9)
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
    bits = max(8, (8 * n).bit_length())
    slot = (grams >> np.uint64(64 - bits)).astype(np.int64)
    at, table = np.arange(n), np.empty(1 << bits, np.int64)
    table[slot] = at  # the last of each slot
    again = table[slot] != at
    table[slot[::-1]] = at[::-1]  # the first
    again |= table[slot] != at
    edges = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
    return [(b, e + 2) for b, e in edges.reshape(-1, 2).tolist()]


def text_runs(words: list[bytes], least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    """find_runs() of a text's words."""
    found = []
    for begin, end in stretches(words):
        if end - begin >= least:
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for w in words[begin:end]], np.int64)
            found += [(begin + start, length, period) for start, length, period in find_runs(ids, least, power)]
    return found


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every run of each text's words, and the text without repetition.

    runs are structs of start (word number from 0), length and period, by start,
    then period. collapsed holds the words left, joined by one space, where of
    each run only the first period stays.

    Null and empty texts have no words and no runs; their collapsed text is
    empty. Texts are read whole, however long; one that repeats a word a million
    times takes time and memory in proportion to its length. Rows that repeat an
    id are told of each; a null id stays null. No rows in: no rows out. Other
    columns never matter.
    """
    if power < 3 or least < 4:
        raise ValueError("runs have at least three periods and four words")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, ends, fields, left = [], [0], ([], [], []), []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()  # bytes: space and U+0009 to U+000D part words
                runs = text_runs(words, least, power)
                n_words.append(len(words))
                ends.append(ends[-1] + len(runs))
                if runs:
                    for into, values in zip(fields, zip(*runs)):
                        into.extend(values)
                    drop = np.zeros(len(words), bool)
                    for start, length, period in runs:
                        drop[start + period : start + length] = True
                    words = [words[i] for i in np.flatnonzero(~drop).tolist()]
                left.append(b" ".join(words))
            structs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), runs, pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    found = over_texts(docs.select(col(id_col).cast("long"), col(text_col).cast("string").cast("binary")), find, SCHEMA)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
