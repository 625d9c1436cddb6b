"""Quality rules: an isolation forest over rule statistics.

Rule statistics of every whole text come first (one Arrow pass, no shuffle).
Fixed base rules fail the plainly bad ones. The rest is judged by an isolation
forest grown from good rows: documents whose statistics random splits isolate
from them after few steps are anomalous, and the limit on the anomaly score is
set from labelled rows that grew no tree.

The range of splits comes from all documents and the limit from all labelled
ones, as totals that Spark adds up. An isolation tree grows from few rows by its
definition; each has its own, drawn by hash from all good labelled ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import bucketed
from .common import col, cut, over_texts

#: White space between words, and the characters that count as symbols.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def text_statistics(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; a null text has none of anything."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space, just as SPACES has it
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= again
    return int(covered.sum())


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATS of each row's whole text; null and empty texts have zeros."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_statistics(x.as_py()) for x in batch.column(1)]
            columns = zip(*found) if found else [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", *STATS]
            )

    return over_texts(docs.select(col(id_col).cast("long"), col(text_col).cast("string")), measure, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(stats: pd.DataFrame) -> np.ndarray:
    """Logarithms of rates (percent), so that length alone makes nothing anomalous and a rate's order of magnitude counts."""
    n = np.maximum(stats["n_words"].to_numpy(float), 1)
    lines = np.maximum(stats["n_lines"].to_numpy(float), 1)
    return np.log1p(100 * np.column_stack([stats[c].to_numpy(float) / d for c, d in zip(STATS[1:5], (n, n, lines, n))]))


def mean_depth(n: np.ndarray | int) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, n - 1)


class IsolationForest:
    """Random axis-parallel splits; arrays only, so that it travels in a closure.

    A split is drawn within its cell, and the root's cell is given: the range of
    all documents. Most good texts have no symbols or repeats at all, and splits
    between the rows at a node, which are then all alike, would never look there.
    """

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 42):
        self.n_trees, self.sample, self.seed = trees, sample, seed

    def fit(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, own: list[np.ndarray] | None = None) -> IsolationForest:
        """Trees from samples of x, or tree t from the rows own[t] of x."""
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x)) if own is None else max(map(len, own))
        depth = max(1, int(np.ceil(np.log2(max(size, 2))))) + 2
        shape = (self.n_trees, (2 << depth) - 1)
        self.feature, self.split = np.full(shape, -1, np.int32), np.zeros(shape)
        self.length, self.depth, self.unit = np.zeros(shape), depth, float(mean_depth(size)) or 1.0
        for t in range(self.n_trees):
            drawn = own[t] if own is not None else rng.choice(len(x), size, replace=False) if len(x) else np.zeros(0, int)
            todo = [(0, drawn, 0, low, high)]
            while todo:
                node, rows, level, a, b = todo.pop()
                self.length[t, node] = level + mean_depth(len(rows))
                open_ = np.flatnonzero(b > a)
                if level == depth or len(rows) <= 1 or not len(open_):
                    continue
                f = int(rng.choice(open_))
                s = rng.uniform(a[f], b[f])
                self.feature[t, node], self.split[t, node] = f, s
                left, below, above = x[rows, f] <= s, b.copy(), a.copy()
                below[f] = above[f] = s
                todo += [(2 * node + 1, rows[left], level + 1, a, below), (2 * node + 2, rows[~left], level + 1, above, b)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / its expectation): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for t in range(self.n_trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > self.split[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.length[t, node]
        return np.exp2(-total / self.n_trees / self.unit)


def calibrate(scores: np.ndarray, good: np.ndarray, most_good_lost: float) -> float:
    """The limit that rejects most bad rows while at most that share of good ones goes.

    Scores above the limit are anomalous. Without good or bad rows: no limit.
    """
    if not good.any() or good.all():
        return np.inf
    s = np.unique(scores)
    limits = np.append((s[:-1] + s[1:]) / 2, s[-1])
    lost = 1 - np.searchsorted(np.sort(scores[good]), limits, "right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(scores[~good]), limits, "right") / (~good).sum()
    allowed = lost <= most_good_lost
    return float(limits[np.argmax(np.where(allowed, caught - lost, -1))])


def calibrated(scored: DataFrame, most_good_lost: float) -> float:
    """calibrate() for rows (score double, good boolean) of any number: equal scores are counted and the counts added up in order.

    Ranges of scores have windows of their own; only their totals and each one's
    best limit are brought together.
    """
    counts = cut(scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")))
    placed = cut(bucketed(counts, "score"))
    totals = placed.groupBy("_bucket").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("score").alias("first")).orderBy("_bucket").collect()
    goods, bads = sum(r["g"] for r in totals), sum(r["b"] for r in totals)
    if not goods or not bads:
        return np.inf
    base, g, b = [], 0, 0
    for i, r in enumerate(totals):
        base.append((r["_bucket"], g, b, totals[i + 1]["first"] if i + 1 < len(totals) else None))
        g, b = g + r["g"], b + r["b"]
    known = scored.sparkSession.createDataFrame(base, "_bucket int, g0 long, b0 long, beyond double")
    within = Window.partitionBy("_bucket").orderBy("score")
    passed = lambda c: F.col(f"{c}0") + F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0))
    lost, caught = 1 - passed("g") / goods, 1 - passed("b") / bads
    above = F.coalesce(F.lead("score").over(within), F.col("beyond"))
    limits = placed.join(F.broadcast(known), "_bucket").select(
        F.coalesce((F.col("score") + above) / 2, F.col("score")).alias("limit"),
        F.when(lost <= most_good_lost, caught - lost).otherwise(-1.0).alias("gain"),
    )
    best = limits.agg(F.max(F.struct("gain", (-F.col("limit")).alias("least"))).alias("best")).first()["best"]
    return -float(best["least"])


def isolate(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_good_lost: float = 0.005,
    trees: int = 100,
    seed: int = 42,
) -> DataFrame:
    """doc_id, STATS, base_failed, anomaly (the forest's score) and kept.

    kept is false for base failures and for anomalies above the calibrated
    limit. `labels` has the id and 1 for good, 0 for bad; null labels and ids
    without a document are passed over. Null and empty texts fail the base
    rules. Repeated rows are judged each, ties alike. Without labels of both
    kinds the forest rejects nothing. No rows in: no rows out. Other columns
    never matter.

    The root cell is the range of all documents that pass the base rules. Half
    of the good labelled rows (all documents, where there are none) may grow
    trees, each from rows that a hash draws among all of them; the limit is set
    on all others, good and bad.
    """
    stats = cut(rule_statistics(docs, id_col, text_col)).withColumn("base_failed", base_failed())
    passed = stats.where(~F.col("base_failed"))
    per = ["n_words", "n_words", "n_lines", "n_words"]
    rates = [F.col(c) / F.greatest(F.col(d), F.lit(1)) for c, d in zip(STATS[1:5], per)]
    ends = passed.agg(*[F.min(r) for r in rates], *[F.max(r) for r in rates]).first()
    low, high = np.log1p(100 * np.array([e or 0.0 for e in ends], float)).reshape(2, 4)
    marked = labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).cast("int").alias("label"))
    by_hash = F.xxhash64(F.lit(seed), "doc_id", *STATS)
    known = cut(
        passed.join(marked.where(F.col("label").isin(0, 1)), "doc_id")
        .withColumn("good", F.col("label") == 1)
        .withColumn("grows", F.col("good") & (F.pmod(by_hash, F.lit(2)) == 0))
    )
    growing = known.where("grows")
    if not growing.limit(1).count():
        growing = passed
    x, own = _drawn(growing, trees, seed)
    margin = 0.05 * (high - low)
    forest = IsolationForest(trees, seed=seed).fit(x, low - margin, high + margin, own)

    @F.pandas_udf("double")
    def anomaly(frame: pd.DataFrame) -> pd.Series:
        distinct, back = np.unique(features(frame), axis=0, return_inverse=True)
        return pd.Series(forest.score(distinct)[back.reshape(-1)])

    judged = known.where("not grows").select(anomaly(F.struct(*STATS)).alias("score"), "good")
    limit = calibrated(judged, most_good_lost)
    return stats.withColumn("anomaly", anomaly(F.struct(*STATS))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(float(limit)))
    )


def _drawn(rows: DataFrame, trees: int, seed: int, sample: int = 256) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features of the rows drawn, and which of them each tree has: those of the least hashes of row and tree, among all rows."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            own = batch["h"].to_numpy().view(np.uint64)
            for t in range(trees):
                mixed = (own ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                rank = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)
                few = np.argsort(rank, kind="stable")[:sample]
                some = batch.iloc[few][list(STATS)].assign(tree=t, rank=rank[few])
                if t < len(held):
                    held[t] = pd.concat([held[t], some]).nsmallest(sample, "rank", keep="first")
                else:
                    held.append(some)
        if held:
            yield pd.concat(held)

    hashed = rows.select(*STATS, F.xxhash64(F.lit(seed), F.lit(1), "doc_id", *STATS).alias("h"))
    kind = ", ".join(f"{c} long" for c in (*STATS, "tree", "rank"))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("rank", *STATS))
    drawn = hashed.mapInPandas(least, kind).withColumn("nth", nth).where(F.col("nth") <= sample).orderBy("tree", "nth").toPandas()
    tree = drawn["tree"].to_numpy()
    return features(drawn), [np.flatnonzero(tree == t) for t in range(trees)]
