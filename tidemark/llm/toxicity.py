"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, ends marked) and itself,
each hashed to one of `buckets` vectors, so a misspelling never seen shares
most vectors with the word it bends. A window of `window` words is averaged
(missing words and words said again at once are zero vectors) and goes through a linear softmax. A text is
as toxic as its most toxic window, so a few words in a long text still count.
Vectors and softmax are trained jointly, in numpy, on the driver, from at most
`fit_rows` labelled texts (clean, toxic), picked by hash of the id.

As everything is linear up to the softmax, scoring needs one number per bucket
and looks up one number per word: one Arrow pass over the texts, no shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, give_back, over_texts

PUNCTUATION = ".,;:!?\"'()[]{}<>*#$%&|-_…«»“”‘’¿¡"
#: Characters of the words whose number each Python worker keeps, and of the longest of them.
CACHE_CHARS, CACHED_WORD = 2_000_000, 64
FOLDS = 5


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is never learnt from."""
    return F.crc32(id_column.cast("string")) % FOLDS


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of a word's n-grams and of the whole; bare punctuation has none."""
    word = word.strip(PUNCTUATION)
    if not word:
        return []
    marked = f"<{word}>"
    if marked.isascii():
        marked = marked.encode()
        parts = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    else:
        parts = [marked[i : i + n].encode("utf-8", "replace") for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        marked = marked.encode("utf-8", "replace")
    parts.append(b"=" + marked)
    return [crc32(p) % buckets for p in parts]


@dataclass
class ToxicModel:
    """`pull`: each bucket's pull from class 0 to class 1; `bias` likewise."""

    pull: np.ndarray
    bias: float
    window: int

    def scorer(self):
        pull, bias, window, buckets = self.pull.tolist(), self.bias, self.window, len(self.pull)

        class Words(dict):
            chars = 0

            def __missing__(self, word):
                ids = grams(word, buckets)
                value = sum([pull[i] for i in ids]) / len(ids) if ids else 0.0
                if len(word) <= CACHED_WORD:
                    self[word] = value
                    self.chars += len(word)
                return value

        words = Words()

        def score(text: str | None) -> float:
            if words.chars > CACHE_CHARS:
                words.clear()
                words.chars = 0
            parts = (text or "").lower().split()
            n = max(1, -(-len(parts) // window))
            values = np.zeros(n * window, np.float32)
            values[: len(parts)] = once = np.fromiter(map(words.__getitem__, parts), np.float32, len(parts))
            values[1 : len(parts)][once[1:] == once[:-1]] = 0  # a word said again at once counts once
            logit = float(values.reshape(n, window).sum(1).max()) / window + bias
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def fit(
    texts: Iterable[str | None],
    toxic: Sequence[bool],
    buckets: int = 1 << 17,
    dim: int = 8,
    window: int = 16,
    epochs: int = 12,
    rate: float = 0.3,
    batch: int = 128,
    seed: int = 42,
) -> ToxicModel:
    """Train on whole texts, taken one at a time; toxic need hold a text's class only once it is taken.

    The first epoch learns from each text's every window, later ones from its top window.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows, of_text = [], []
    for i, text in enumerate(texts):
        parts = np.array([vocabulary.setdefault(w, len(vocabulary)) + 1 for w in (text or "").lower().split()], np.int32)
        parts[1:][parts[1:] == parts[:-1]] = 0
        n = max(1, -(-len(parts) // window))
        padded = np.zeros(n * window, np.int32)  # word 0 is no word
        padded[: len(parts)] = parts
        rows.append(padded.reshape(n, window))
        of_text.append(np.full(n, i, np.int32))
    toxic = np.array(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = (toxic.sum() + 1) / (len(toxic) + 2)
        return ToxicModel(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), window)

    windows, of_text = np.concatenate(rows), np.concatenate(of_text)
    del rows
    flat, size = array("i"), array("i", [0])
    for word in vocabulary:
        flat.extend(ids := grams(word, buckets))
        size.append(len(ids))
    del vocabulary
    flat, size = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.frombuffer(size, np.int32)
    begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    vectors = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    softmax = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps = [np.full(x.shape, 1e-6, np.float32) for x in (vectors, softmax, bias)]
    first = np.flatnonzero(np.concatenate([[True], of_text[1:] != of_text[:-1]]))

    def pulls() -> np.ndarray:
        pull = vectors @ (softmax[:, 1] - softmax[:, 0])
        sums = np.add.reduceat(np.append(pull[flat], np.float32(0)), begin[:-1]) * (size > 0)
        return (sums / np.maximum(size, 1)).astype(np.float32)

    for epoch in range(epochs):
        if epoch == 0:
            chosen = rng.permutation(len(windows))
        else:
            value = pulls()[windows].sum(1)
            top = np.maximum.reduceat(value, first)
            at_top = np.flatnonzero(value == top[of_text])
            chosen = at_top[np.unique(of_text[at_top], return_index=True)[1]]
            chosen = rng.permutation(chosen)
        for i in range(0, len(chosen), batch):
            rows_ = chosen[i : i + batch]
            words = windows[rows_]
            which, slot = np.nonzero(size[words])
            word = words[which, slot]
            if not len(word):
                continue
            count = size[word]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(begin[word], count)
            g = flat[at]
            word_vec = np.add.reduceat(vectors[g], ends - count, axis=0) / count[:, None]
            mean = np.zeros((len(rows_), dim), np.float32)
            np.add.at(mean, which, word_vec)
            mean /= window
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows_)), toxic[of_text[rows_]].astype(int)] -= 1
            p /= len(rows_)
            d_mean = (p @ softmax.T) / window
            d_word = d_mean[which] / count[:, None]
            touched, back = np.unique(g, return_inverse=True)
            d_gram = np.repeat(d_word, count, axis=0)
            d_vec = np.column_stack([np.bincount(back, d_gram[:, k], len(touched)) for k in range(dim)])
            for x, s, d, where in (
                (softmax, steps[1], mean.T @ p, ...),
                (bias, steps[2], p.sum(0), ...),
                (vectors, steps[0], d_vec, touched),
            ):
                s[where] += d**2
                x[where] -= rate * d / np.sqrt(s[where])
    pull = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    return ToxicModel(pull, float(bias[1] - bias[0]), window)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: tuple[int, int] = (5000, 3500),
    fit_bytes: int = 64 << 20,
    **how,
) -> ToxicModel:
    """Fit on labelled texts outside fold 0, at most fit_rows[y] ids of class y by hash of the id, and fit_bytes in all.

    Whole texts come one at a time and are kept as numbers of words; past
    fit_bytes ids of each class are left out from the last by hash on.

    Null ids, labels other than 0 and 1 and labels without a text are passed
    over; where an id has several texts or labels the least one counts.
    """
    ids = (
        labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("id")) != 0))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    by_hash = (F.xxhash64(F.col("id")), F.col("id"))
    picked = [ids.where(F.col("y") == y).orderBy(*by_hash).limit(fit_rows[y]) for y in (0, 1)]
    # At most sum(fit_rows) ids, so this may be broadcast at any size of corpus.
    few = docs.sparkSession.createDataFrame(
        [(*r, n) for p in picked for n, r in enumerate(p.collect())], "id long, y int, place int"
    )
    found = cut(
        docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
        .join(F.broadcast(few), "id")
        .groupBy("id", "y", "place")
        .agg(F.min("text").alias("text"))
    )
    sizes = found.select("place", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toPandas().sort_values(["place", "y"])
    within = sizes["size"].cumsum() <= fit_bytes
    last = int(sizes["place"][~within].min()) if not within.all() else max(fit_rows)
    toxic: list[bool] = []

    def texts() -> Iterator[str | None]:
        for row in found.where(F.col("place") < last).orderBy("id").select("y", "text").toLocalIterator():
            toxic.append(row["y"] == 1)
            yield row["text"]

    model = fit(texts(), toxic, **how)
    give_back()
    return model


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Struct column `row` with the columns in `keep` (all by default), and score and predicted."""
    kept = F.struct(*[col(c) for c in (keep or docs.columns)]).alias("row")
    rows = docs.select(kept, col(text_col).cast("string").alias("text"))
    shape = rows.select("row", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            scores = [scorer(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["row", "score", "predicted"],
            )

    return over_texts(rows, run, shape)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts score as a text without words does; repeated rows score
    alike; a null id is not held out. With labels of one class, or none, all
    texts get that share. No rows in: no rows out. Other columns never matter.
    """
    model = learn(docs, labels, id_col, text_col, label_col, **how)
    scored = score(docs, model, text_col, keep=[id_col])
    doc_id = F.col("row").getField(id_col).cast("long")
    return scored.select(
        doc_id.alias("doc_id"),
        F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs without the rows predicted toxic, columns unchanged.

    Null and empty texts go only if a text without words scores 0.5 or more;
    repeated rows go or stay together; no rows in: no rows out.
    """
    model = learn(docs, labels, text_col=text_col, **how)
    return score(docs, model, text_col).where(F.col("predicted") == 0).select("row.*")
