"""Mix sources to target weights by repeating and sampling documents.

Tokens are added up per source, every source gets a target share of the words
to emit, and rate = target / size says how often each of its documents is
emitted: floor(rate) times, plus once more with probability equal to the
fraction, decided by a seeded hash of the document's id.

Everything is native. Per document only (id, source, size) rows move, and they
move only if the table of sources is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_position, with_running_sum
from .common import col, cut, n_words

SEED = 42


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, weigh as `weights` repeats. Targets
    share budget = numerator / denominator of all words in proportion to weight,
    but none exceeds cap times its source; what is cut off is shared again by
    weight until nothing is above. That fixed point is a water level: sort by
    cap * size / weight, and sources are capped up to the first one whose share
    of what is left stays below its cap.

    Ranks and sums before come from ordering.py's buckets, so a table of many
    sources, hosts for instance, is no single task's either.
    """
    num, den = budget
    sizes = cut(sizes)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = with_position(sizes.where(F.col("source").isNotNull()), "source", "rank")
    last = sizes.where(F.col("source").isNull()).withColumn("rank", F.lit(named.count()).cast("long"))
    ranked = cut(
        named.unionByName(last)
        .withColumn("weight", w.cast("long"))
        .withColumn("ratio", (F.lit(cap) * F.col("source_size")).cast("double") / F.col("weight"))
    )
    by_ratio = cut(ranked.groupBy("ratio").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")))  # no ties
    placed = with_running_sum(by_ratio, "ratio", F.col("size"), "capped_size")
    placed = with_running_sum(placed, "ratio", F.col("weight"), "capped_weight")
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    judged = (
        placed.crossJoin(F.broadcast(whole))
        .withColumn(
            "level",
            (num * F.col("all_size") - den * cap * F.col("capped_size")).cast("double")
            / (den * (F.col("all_weight") - F.col("capped_weight"))).cast("double"),
        )
        .withColumn("below", F.col("level") < F.col("ratio"))
    )
    first = judged.where("below").agg(F.min(F.struct("ratio", "level"))["level"].alias("at"))  # one row
    level = ranked.crossJoin(F.broadcast(first))
    full = (F.lit(cap) * F.col("source_size")).cast("double")
    target = F.when(F.col("at").isNull() | (F.col("ratio") <= F.col("at")), full).otherwise(
        F.col("weight") * F.col("at")
    )
    return level.select("source", "source_size", target.alias("target"))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    keep: Sequence[str] | None = None,
    **how,
) -> DataFrame:
    """How often each document is emitted.

    Returns one struct column `row` with the columns in `keep` (default: the id
    alone), and doc_id, size, source_size, target, rate and copies beside it.

    Null texts and texts without words have size 0 and still get copies. Null is
    a source of its own. Rows that repeat an id share its coin; rows without an
    id toss by their text. No rows in: no rows out. Other columns never matter,
    whatever their names.
    """
    kept = F.struct(*[col(c) for c in (keep or [id_col])]).alias("row")
    coin = F.md5(
        F.concat_ws("|", F.lit(seed).cast("string"), F.coalesce(col(id_col).cast("string"), F.md5(col(text_col).cast("binary")), F.lit("~")))
    )
    sized = docs.select(
        kept,
        col(id_col).alias("doc_id"),
        col(source_col).alias("source"),
        n_words(col(text_col)).alias("size"),
        (F.conv(F.substring(coin, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("u"),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, **how)).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .withColumn(
            "copies",
            (F.floor("rate") + F.when(F.col("u") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"),
        )
        .select("row", "doc_id", "size", "source_size", "target", "rate", "copies")
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as mixing_plan() says, columns unchanged.

    Nulls, ties, repeats and empty tables: as mixing_plan(). A source without words gives nothing.
    """
    plan = mixing_plan(docs, keep=docs.columns, **how)
    return plan.where(F.col("copies") > 0).withColumn(
        "again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).select("row.*")
