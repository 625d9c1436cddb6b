"""What the training-data operators share: words, columns, cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir

#: A word: a maximal run of characters outside space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """The top-level column of that very name, dots and ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of open scratch() blocks, the innermost last.
_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end; whatever reads them must be written by then."""
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    try:
        yield
    finally:
        _SCRATCH.remove(path)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of any store that Spark reads, and all in it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation, and the
    planner knows the table's size, so it broadcasts a side only if its files
    are below spark.sql.autoBroadcastJoinThreshold and shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to Python at once, where the session still has Spark's own numbers: texts may be long.
BATCHES = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"),
)


def over_texts(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches of bounded size, and memory given back when a task ends."""
    conf = rows.sparkSession.conf
    for name, sparks, ours in BATCHES:
        if conf.get(name, None) in (None, sparks):
            conf.set(name, ours)

    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(lean, schema)


def give_back() -> None:
    """Freed memory to the system: workers, and the driver, outlive what they hold for a task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the bitmap by which may_be_among() tells rows apart; its table has a row for each 64, whatever the input.
BITMAP_BITS = 1 << 22


def may_be_among(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """df with boolean `name`: false only where the long column `key` is surely not in keys' column of that name.

    A bitmap of BITMAP_BITS bits, so at most BITMAP_BITS / 64 rows, is broadcast.
    It lets rows that a join would only pass on stay where they are. With more
    keys than bits it tells nothing apart and all rows are true.
    """
    slot = F.pmod(F.col(key), F.lit(BITMAP_BITS)).cast("int")
    set_bit = lambda at: F.expr(f"shiftleft(1L, cast(pmod({at}, 64) as int))")
    bitmap = (
        keys.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).cast("int").alias("_word"))
        .agg(F.bit_or(set_bit("_slot")).alias("_mask"))
    )
    marked = df.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64).cast("int")).join(F.broadcast(bitmap), "_word", "left")
    hit = F.coalesce(F.col("_mask").bitwiseAND(set_bit("_slot")) != 0, F.lit(False))
    return marked.withColumn(name, hit).drop("_slot", "_word", "_mask")
