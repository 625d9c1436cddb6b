"""Event time over streams: sessions and fixed windows per key, with a limit on how late rows may be.

The functions only declare the aggregation, so they take a stream or a table
alike. On a stream, state is kept per key and open window; a watermark closes
windows and drops rows that come later than `late` behind the newest event, so
state is bounded by what arrives in that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a window tells of its events.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _measures(value: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(value).alias("total")]


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, start, end, n, total): events of a key that follow each other within `gap`; end is the last event's time and the gap.

    Rows without a time or key are left out; null values add nothing. A table
    gives all sessions, a stream each when the watermark has passed its end.
    """
    kept = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late)
    found = kept.groupBy(F.session_window(ts, gap).alias("w"), key).agg(*_measures(F.col(value)))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windows(
    events: DataFrame, size: str = "1 hour", step: str | None = None, late: str = "1 hour", key: str = "event_type", ts: str = "ts", value: str = "value"
) -> DataFrame:
    """(key, start, end, n, total) of fixed windows, one after another or, with a step below size, overlapping. Else as sessions()."""
    kept = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late)
    found = kept.groupBy(F.window(ts, size, step or size).alias("w"), key).agg(*_measures(F.col(value)))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def drained(spark: SparkSession, folder: str, schema: str, aggregate, out: str, checkpoint: str) -> DataFrame:
    """Run aggregate over the Parquet files that a folder has and hasn't given yet, appending closed windows to out; all of out so far.

    State stays in the checkpoint folder between runs, as between restarts of a stream.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    query = aggregate(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(aggregate(spark.createDataFrame([], schema)).schema).parquet(out)
