"""Documents that keep arriving: chunk, embed and upsert each micro-batch.

A batch writes a folder of its own, named by its number, so a batch that is run
again overwrites itself. When MOST folders have gathered, all but the newest are
merged: the newest version of each file so far goes to one folder `upto=n`,
which takes its name when it is whole, and the folders that it stands for are
deleted. Readers take the last such folder and the batches after it, so what a
merge that broke off left behind changes nothing. So an index has at most MOST
folders and one more, whatever the number of batches.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import split_text
from ..providers import with_embedding
from ..session import delete_path, list_paths

DOCUMENT_SCHEMA = "filename string, content string"
#: Batch folders that may gather before they are merged.
MOST = 16


def documents_stream(spark: SparkSession, folder: str, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """New Parquet files of documents, as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def chunked(stream: DataFrame, max_chars: int = 1000, overlap: int = 100) -> DataFrame:
    """(filename, chunk_id, content), stateless and so without a watermark.

    A document without text, null or empty, gives one row without chunk_id and
    content: it takes the place of the file's earlier version, whose chunks go.
    """
    chunks = F.posexplode_outer(split_text(F.col("content"), max_chars, overlap)).alias("chunk_id", "content")
    return stream.select("filename", chunks)


def start_ingest(
    stream: DataFrame, client: Any, index_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Embed chunks and keep the newest version of each file in a Parquet index, which read_latest() reads.

    A file that comes twice in a batch keeps one row for each chunk number.
    """

    def write(batch: DataFrame, number: int) -> None:
        vectors = with_embedding(batch.dropDuplicates(["filename", "chunk_id"]), client, "content")
        vectors.write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        compact(batch.sparkSession, index_path, keep=number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _folders(spark: SparkSession, index_path: str) -> tuple[int, dict[int, str]]:
    """Up to which batch the index is merged (-1: not at all), and the folders to read by number, the merged one first."""
    found: dict[str, dict[int, str]] = {"upto": {}, "batch": {}}
    for path in list_paths(spark, index_path):
        kind, _, number = path.rpartition("/")[2].partition("=")
        if kind in found and number.isdigit():
            found[kind][int(number)] = path
    last = max(found["upto"], default=-1)
    merged = {last: found["upto"][last]} if last >= 0 else {}
    return last, merged | {n: p for n, p in sorted(found["batch"].items()) if n > last}


def _rows(spark: SparkSession, folders: dict[int, str]) -> DataFrame:
    """Rows of folders with the number of theirs, of each file only those of the newest."""
    rows = reduce(DataFrame.unionByName, (spark.read.parquet(p).withColumn("batch", F.lit(n)) for n, p in folders.items()))
    newest = rows.groupBy("filename").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["filename", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, index_path: str, keep: int, most: int = MOST) -> bool:
    """Merge folders of batches before `keep`, which may be run again, if more than `most` are there; whether it did.

    Files whose newest version has no text leave the index with the merge.
    """
    last, folders = _folders(spark, index_path)
    before = {n: p for n, p in folders.items() if n < keep}
    if len(before) <= most:
        return False
    upto, staged = max(before), f"{index_path}/_merging"
    _rows(spark, before).where(F.col("chunk_id").isNotNull()).write.mode("overwrite").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.rename(path(staged), path(f"{index_path}/upto={upto}")):
        raise RuntimeError(f"{staged} couldn't be renamed")
    for found in list_paths(spark, index_path):
        kind, _, number = found.rpartition("/")[2].partition("=")
        if number.isdigit() and (kind == "batch" and int(number) <= upto or kind == "upto" and int(number) < upto):
            delete_path(spark, found)
    return True


def read_latest(spark: SparkSession, index_path: str) -> DataFrame:
    """The chunks of each file's newest version."""
    _, folders = _folders(spark, index_path)
    if not folders:
        raise FileNotFoundError(f"no index at {index_path}")
    return _rows(spark, folders).where(F.col("chunk_id").isNotNull())
