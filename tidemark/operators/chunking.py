"""Splitting texts: at word boundaries, in fixed windows, and across a whole corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .ordering import with_running_sum


def boundary_spans(text: str, max_chars: int, overlap: int, lossless: bool = False) -> list[tuple[int, int]]:
    """Spans of at most max_chars that end before white space where they can.

    The next span begins overlap before the end of the last one, or, if that
    wouldn't move on, max_chars after its start, which loses what lies between;
    lossless begins at the end instead.
    """
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(start + max_chars, n)
        if end < n:
            back = max(text.rfind(space, start + 1, end + 1) for space in " \n\t")
            end = back if back > start else start + max_chars
        spans.append((start, end))
        if end - overlap > start:
            start = end - overlap
        else:
            start = end if lossless else start + max_chars
    return spans


def split_text(text: Column, max_chars: int = 1000, overlap: int = 100, lossless: bool = False) -> Column:
    """Array of boundary-aware chunks of each text; null gives null."""
    if max_chars < 1 or overlap < 0:
        raise ValueError("max_chars must be positive and overlap not negative")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else [t[a:b] for a, b in boundary_spans(t, max_chars, overlap, lossless)]
        )

    return split(text)


def chunk_text(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of fixed windows that step by size - overlap; empty for empty texts."""
    step = _step(size, overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    chunks = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(text.isNotNull(), F.coalesce(chunks, F.array().cast("array<string>")))


def _step(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in 0 .. size - 1, or chunking would never end")
    return size - overlap


def explode_chunks(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk: keep, chunk_id from 0, content."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_id", "content"))


def chunk_corpus(df: DataFrame, text_col: str, order_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(chunk_id, content) of all texts joined by newlines in order, as fixed windows across documents.

    The joined corpus never exists: every text learns its offset from a running
    sum, cuts its part of each window it touches, and parts meet by window.
    Null texts are left out.
    """
    step = _step(size, overlap)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("body"), F.col(order_col).alias("ord"))
    placed = with_running_sum(texts, "ord", F.length("body") + 1, "off")
    last = placed.agg(F.max(F.col("off") + F.length("body") + 1)).first()[0]
    if last is None:
        return df.sparkSession.createDataFrame([], "chunk_id long, content string")
    # the newline after the last text isn't there
    whole = placed.withColumn(
        "body", F.when(F.col("off") + F.length("body") + 1 == last, F.col("body")).otherwise(F.concat("body", F.lit("\n")))
    ).withColumn("n", F.length("body")).where(F.col("n") > 0)
    low = F.greatest(F.floor((F.col("off") - size) / step) + 1, F.lit(0))
    high = F.floor((F.col("off") + F.col("n") - 1) / step)
    parts = whole.withColumn("k", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("off"), F.col("k") * step)
    end = F.least(F.col("off") + F.col("n"), F.col("k") * step + size)
    piece = F.substring("body", (begin - F.col("off") + 1).cast("int"), (end - begin).cast("int"))
    pieces = parts.where(end > begin).select(F.col("k").alias("chunk_id"), "off", piece.alias("piece"))
    return (
        pieces.groupBy("chunk_id")
        .agg(F.sort_array(F.collect_list(F.struct("off", "piece"))).alias("parts"))
        .select("chunk_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("content"))
    )


def managed_rows(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(ord, content) of a managed index's input: texts that aren't null or blank, unchunked."""
    kept = df.where(~is_blank(F.col(text_col)))
    return kept.select(F.col(order_col).alias("ord"), F.col(text_col).cast("string").alias("content"))
