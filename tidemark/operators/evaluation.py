"""Scoring answers: sentence BLEU, a judge's reply, and metrics over both."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, words

# What a judge's reply looks like, and the names of evaluation columns.
NUMBER = r"([0-1](?:\.\d+)?)"
SCORE_LINES = [
    ("Answer Relevance", rf"Answer Relevance:\s*{NUMBER}"),
    ("Accuracy", rf"Accuracy:\s*{NUMBER}"),
    ("Completeness", rf"Completeness:\s*{NUMBER}"),
    ("Clarity", rf"Clarity:\s*{NUMBER}"),
    ("Semantic Similarity", r"Semantic Similarity Score:\s*(\d{1,3})%"),
]
METRICS = [
    ("avg_bleu", "BLEU Score"),
    ("avg_answer_relevance", "Answer Relevance"),
    ("avg_accuracy", "Accuracy"),
    ("avg_completeness", "Completeness"),
    ("avg_clarity", "Clarity"),
    ("avg_semantic_similarity", "Semantic Similarity"),
]
SIMILAR = 80
#: Orders of n-grams that BLEU counts.
ORDERS = 4


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _clipped(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    """Matches of n-grams of each order, each counted at most as often as the reference has it: one count a gram, linear in tokens."""

    def counted(tokens, n: int) -> Counter:
        return Counter(zip(*(tokens[i:] for i in range(n))))

    def matches(c, r) -> list[float]:
        c, r = list(c), list(r)
        return [float(sum((counted(c, n) & counted(r, n)).values())) for n in range(1, ORDERS + 1)]

    return pd.Series([None if c is None or r is None else matches(c, r) for c, r in zip(candidate, reference)])


def bleu(reference: Column, candidate: Column) -> Column:
    """Sentence BLEU-4 of white-space tokens, one reference, zero precisions smoothed by length.

    A zero precision of order n becomes ln(c) / (5 * 2^v) matches, v counting
    such orders so far, where c > 1 tokens; orders still at zero are left out.
    Without a common token the score is 0.
    """
    r, c = words(reference), words(candidate)
    hits = _clipped(c, r)
    return _smoothed([hits[i] for i in range(ORDERS)], F.size(c).cast("double"), F.size(r).cast("double"))


def _smoothed(hits: list[Column], n_c: Column, n_r: Column) -> Column:
    sizes = [F.greatest(n_c - (n - 1), F.lit(1.0)) for n in range(1, 5)]
    zeros, total = F.lit(0), F.lit(0.0)
    for h, size in zip(hits, sizes):
        zeros = zeros + F.when(h == 0, 1).otherwise(0)
        smooth = F.when(n_c > 1, F.ln(n_c) / (5 * F.pow(F.lit(2.0), zeros)))
        total = total + 0.25 * F.coalesce(F.ln(F.when(h > 0, h).otherwise(smooth) / size), F.lit(0.0))
    brevity = F.when(n_c > n_r, 1.0).when(n_c > 0, F.exp(1 - n_r / n_c)).otherwise(0.0)
    return F.when(hits[0] > 0, brevity * F.exp(total)).otherwise(0.0)


def judge_scores(reply: Column) -> dict[str, Column]:
    """The judge's five scores and explanation: the first line missing leaves those after it at 0."""
    out: dict[str, Column] = {}
    so_far = F.lit(True)
    for name, pattern in SCORE_LINES:
        found = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), pattern, 1), F.lit(""))
        so_far = so_far & found.isNotNull()
        out[name] = F.when(so_far, found.cast("double")).otherwise(0.0)
    out["Explanation"] = strip(reply)
    return out


def with_scores(df: DataFrame, reply: Column) -> DataFrame:
    """df with BLEU Score, the judge's scores and Explanation."""
    return df.withColumns({"BLEU Score": bleu(F.col("`ground truth`"), F.col("answer")), **judge_scores(reply)})


def predicted(similarity: Column) -> Column:
    """1 for similarity of SIMILAR and more, else 0."""
    return F.when(similarity >= SIMILAR, 1).otherwise(0)


def metrics(scored: DataFrame) -> DataFrame:
    """One row: six means, and precision, recall and F1 against a truth that is always 1; null without rows."""
    hit = predicted(F.col("`Semantic Similarity`"))
    means = [F.avg(F.col(f"`{c}`").cast("double")).alias(m) for m, c in METRICS]
    one = scored.agg(*means, F.avg(hit).alias("recall"), F.max(hit).cast("double").alias("precision"))
    f1 = F.when(F.col("recall") > 0, 2 * F.col("recall") / (1 + F.col("recall"))).when(F.col("recall") == 0, 0.0)
    return one.select(*[m for m, _ in METRICS], "precision", "recall", f1.alias("f1_score"))
