"""Greedy batches under a budget of characters, in two parallel passes.

Batching is a recurrence: whether a row opens a batch depends on all rows
before. But what a range of rows does to the open batch is a step function of
how full that batch is on entry. One pass computes every range's function, the
driver composes them (a few numbers per range), and a second pass numbers all
ranges' rows at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .ordering import bucketed


def fill_batches(sizes: np.ndarray, limit: int, used: int = 0) -> tuple[np.ndarray, int]:
    """For each size whether it opens a new batch, given how full the open one is; and how full it is then."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    opens = np.zeros(len(sizes), bool)
    at, base = 0, -used  # total - base is what the open batch holds
    while at < len(sizes):
        j = int(np.searchsorted(total, base + limit, "right")) - 1  # rows before j fit
        if base == total[at]:  # an empty batch takes any row
            j = max(j, at + 1)
        j = max(j, at)
        if j >= len(sizes):
            break
        opens[j] = True
        at, base = j, total[j]
        if total[j + 1] - base > limit:  # too large: alone in its batch
            at = j + 1
            if at < len(sizes):
                opens[at] = True
                base = total[at]
    return opens, int(total[-1] - base)


def step_function(sizes: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(fullness from, batches opened, fullness then), ascending, for fullness 1 and up; see compose()."""
    total = np.cumsum(sizes)
    steps, seen = [], None
    for j in range(len(sizes)):
        least = max(1, int(limit - total[j] + 1))  # so full, row j opens a batch if none before does
        if seen is None or least < seen:
            opens, then = fill_batches(sizes[j:], limit)
            steps.append((least, int(opens.sum()) + 1, then))
            seen = least
        if least == 1:
            break
    return sorted(steps)


def compose(steps: list, added: int, used: int) -> tuple[int, int]:
    """Batches opened and fullness after a range entered so full; added: the range's sizes in all."""
    chosen = None
    for least, opened, then in steps:
        if used >= least:
            chosen = (opened, then)
    return chosen or (0, used + added)


def greedy_batches(df: DataFrame, text_col: str, order_col: str, max_chars: int = 10_000, buckets: int | None = None) -> DataFrame:
    """(order_col, batch, content): stripped non-blank texts in order, in batches of at most max_chars.

    A text that alone exceeds max_chars is a batch of its own. Null and blank
    texts are skipped; joiners between texts don't count. Rows of equal order go
    by a hash; of rows equal in order and text all go to the first one's batch.
    """
    rows = df.where(~is_blank(F.col(text_col))).select(F.col(order_col).alias("ord"), strip(F.col(text_col)).alias("content"))
    sizes_only = rows.select("ord", F.length("content").alias("n"), F.xxhash64("content").alias("text"))
    cut = bucketed(sizes_only, "ord", buckets).select("_bucket", "_tie", "ord", "n", "text")

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        sizes = g.sort_values(["ord", "_tie"], na_position="first")["n"].to_numpy("int64")
        opens, then = fill_batches(sizes, max_chars)
        return pd.DataFrame(
            {
                "bucket": g["_bucket"].iloc[:1].astype("int32"),
                "added": [int(sizes.sum())],
                "fresh": [[int(opens.sum()), then]],
                "steps": [[list(s) for s in step_function(sizes, max_chars)]],
            }
        )

    told = cut.groupBy("_bucket").applyInPandas(
        measure, "bucket int, added long, fresh array<long>, steps array<array<long>>"
    )
    entry, batch, used = {}, 0, 0
    for r in sorted(told.collect(), key=lambda r: r["bucket"]):  # a row per range
        entry[r["bucket"]] = (batch, used)
        opened, used = compose(r["steps"], r["added"], used) if used else r["fresh"]
        batch += opened

    def number(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ord", "_tie"], na_position="first")
        first, full = entry[int(g["_bucket"].iloc[0])]
        opens, _ = fill_batches(g["n"].to_numpy("int64"), max_chars, full)
        return pd.DataFrame({"ord": g["ord"], "text": g["text"], "batch": first + np.cumsum(opens)}).drop_duplicates(["ord", "text"])

    kind = rows.schema["ord"].dataType.simpleString()
    numbered = cut.groupBy("_bucket").applyInPandas(number, f"ord {kind}, text long, batch long")
    named = numbered.groupBy("ord", "text").agg(F.min("batch").alias("batch")).select(F.col("ord").alias("_o"), "text", "batch")
    held = rows.withColumn("text", F.xxhash64("content"))
    return held.join(named, held["ord"].eqNullSafe(named["_o"]) & (held["text"] == named["text"])).select(held["ord"].alias(order_col), "batch", "content")


def joined_batches(batched: DataFrame, order_col: str) -> DataFrame:
    """(batch, content): each batch's texts joined by a space in order."""
    return batched.groupBy("batch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, "content"))), lambda s: s["content"]), " ").alias("content")
    )


def count_batches(df: DataFrame, text_col: str = "content", max_chars: int = 10_000, order_col: str = "doc_seq") -> int:
    """Number of greedy batches; 0 without any text."""
    last = greedy_batches(df, text_col, order_col, max_chars).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1
