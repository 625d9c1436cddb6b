"""Row order as a distributed operation: running sums and positions without one big sort task.

Rows are bucketed by ranges of the order column and a hash that breaks its ties
(bounds from a sample), each bucket runs its own window, and bucket totals, one
row each, are added up first. No step puts all rows into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a bucket may have, about; and sampled rows that place each bound.
BUCKET_ROWS, SAMPLE_PER_BUCKET = 1 << 20, 50
#: Bounds that a row is held against one by one.
STEPS = 64


def _tie(df: DataFrame) -> Column:
    """Tells rows of equal order apart by what they hold, the same whenever they are read; only equal rows stay tied."""
    return F.xxhash64(*[F.col(f"`{c}`") if t != "map" else F.to_json(F.col(f"`{c}`")) for c, t in ((c, t[:3]) for c, t in df.dtypes)])


def bucketed(df: DataFrame, order_col: str, buckets: int | None = None) -> DataFrame:
    """df with `_tie` and `_bucket`, non-decreasing in (order column, _tie); nulls come first.

    As many buckets as rows ask for and partitions there are. Bounds are pairs
    of order and tie from a hash-picked sample of bounded size, so rows of one
    order value spread over buckets too; any orderable type will do.
    """
    tied = df.withColumn("_tie", _tie(df))
    if buckets is None:
        buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    if buckets == 1:
        return tied.withColumn("_bucket", F.lit(0))
    at = F.struct(F.col(order_col).alias("o"), F.col("_tie").alias("t"))
    picked = tied.select(at.alias("at"), F.xxhash64("_tie").alias("h")).orderBy("h").limit(SAMPLE_PER_BUCKET * buckets)
    rows = [r["at"] for r in picked.orderBy("at").collect()]
    bounds = sorted({len(rows) * i // buckets for i in range(1, buckets)} - {0})
    if not bounds:
        return tied.withColumn("_bucket", F.lit(0))
    kind = tied.select(at.alias("at")).schema["at"].dataType
    limits = [F.struct(F.lit(rows[i]["o"]).cast(kind["o"].dataType).alias("o"), F.lit(rows[i]["t"]).alias("t")) for i in bounds]
    below = lambda some: F.size(F.filter(some, lambda b: b <= at))
    if len(limits) <= STEPS:
        return tied.withColumn("_bucket", below(F.array(*limits)))
    # in two steps, so that a row meets twice the root of the number of bounds
    size = math.isqrt(len(limits)) + 1
    groups = F.array(*[F.array(*limits[i : i + size]) for i in range(0, len(limits), size)])
    first = tied.withColumn("_group", below(F.array(*limits[::size])))
    inside = F.when(F.col("_group") > 0, (F.col("_group") - 1) * size + below(F.get(groups, F.col("_group") - 1))).otherwise(0)
    return first.withColumn("_bucket", inside.cast("int")).drop("_group")


def with_running_sum(df: DataFrame, order_col: str, value: Column, name: str, buckets: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before, in order; rows of equal order go by a hash of what they hold."""
    cut = bucketed(df.withColumn("_value", value.cast("long")), order_col, buckets)
    totals = cut.groupBy("_bucket").agg(F.sum("_value").alias("_total"))
    # One row per bucket, so this window and this broadcast are bounded by the number of buckets.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_bucket").orderBy(order_col, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(F.broadcast(base), "_bucket")
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_bucket", "_tie", "_value", "_base")
    )


def with_position(df: DataFrame, order_col: str, name: str = "id", offset: int = 0) -> DataFrame:
    """df with positions 0, 1, ... in order."""
    return with_running_sum(df, order_col, F.lit(1), name).withColumn(name, F.col(name) + offset)


def head(df: DataFrame, order_col: str | None, limit: int | None) -> DataFrame:
    """The first rows in order, or as the frame comes where no column is named; None takes all, 0 none."""
    if limit is None:
        return df
    return df.limit(limit) if order_col is None else df.orderBy(order_col).limit(limit)


def head_or_all(df: DataFrame, order_col: str | None, limit: int | None) -> DataFrame:
    """As head(), but 0 too takes all, as evaluation's row limit has it."""
    return head(df, order_col, limit or None)
