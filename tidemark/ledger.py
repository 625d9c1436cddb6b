"""Model calls that are kept as they come: nobody asks twice, and all tasks share one rate.

A call's key is a hash of the client's model, its settings and the prompt. What a
ledger folder holds isn't asked again, by this job or a later one. What it lacks
is asked once for each different prompt, in as many partitions as calls may run
at a time. A task saves each reply as a file of its key before it asks the next,
and looks for that file first; so a task that is run again, after a lost
executor or a failure, asks only what had no answer yet. When all are answered,
the files become rows of the ledger's table, in one commit, and go.

A budget of calls a minute is dealt evenly over the partitions, each of which
waits between its calls. As no more partitions run than calls may at a time,
the sum keeps the budget whatever the number of executors.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import delete_path, list_paths

SCHEMA = "key string, reply string, error string"
#: Calls at a time, unless named.
AT_A_TIME = 8


def replies(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, reply, error) that a ledger has; none where it doesn't exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{ledger}/replies")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def call_key(client: Any, prompt: Column, system_prompt: str | None, max_tokens: int) -> Column:
    """What tells calls apart: provider, model, address, system prompt, length and prompt."""
    told = [getattr(client, n, None) for n in ("provider", "model", "base_url", "system_prompt")]
    return F.sha2(F.concat(F.lit(json.dumps([*told, system_prompt, max_tokens])), F.lit("\n"), prompt), 256)


class Saved:
    """Results by key as small files in a folder that all tasks reach: made once, and found again by a task that is run again.

    The folder is a URI that Arrow opens or a local path. A file takes its name
    when it is whole. Between an effect and its file a task can still be lost:
    that one effect may happen again, no earlier one.
    """

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

    def get(self, key: str, make: Callable[[], Any]) -> Any:
        """The JSON value of a key, from its file or made now and saved."""
        folder = f"{self.path}/{key[:2]}"
        name = f"{folder}/{key}.json"
        if self.store.get_file_info(name).is_file:
            return json.loads(self.store.open_input_stream(name).read())
        value = make()
        self.store.create_dir(folder, recursive=True)
        written = f"{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(written) as out:
            out.write(json.dumps(value).encode())
        self.store.move(written, name)
        return value


def with_kept_reply(
    df: DataFrame,
    client: Any,
    prompt_col: str,
    ledger: str,
    out_col: str = "reply",
    system_prompt: str | None = None,
    max_tokens: int = 1024,
    error_col: str | None = None,
    at_a_time: int = AT_A_TIME,
    calls_a_minute: float | None = None,
) -> DataFrame:
    """df with a reply for each prompt, from the ledger folder or asked now and kept there; null prompts have none.

    Without error_col a failed call fails the job, and what was answered stays
    answered. With it, the message is kept instead of a reply and the reply is
    null; a later job asks again. ledger is a folder that executors share, as a
    URI that Arrow opens, or a local path.
    """
    spark, pause = df.sparkSession, 60.0 * at_a_time / calls_a_minute if calls_a_minute else 0.0
    keyed = df.withColumn("_key", call_key(client, F.col(prompt_col), system_prompt, max_tokens))
    held = replies(spark, ledger).where("error is null")
    missing = keyed.where(F.col(prompt_col).isNotNull()).groupBy("_key").agg(F.first(prompt_col).alias("prompt")).join(held, F.col("_key") == F.col("key"), "left_anti")
    waiting = f"{ledger.rstrip('/')}/waiting"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        saved, last = Saved(waiting), 0.0

        def call(prompt: str) -> str:
            nonlocal last
            if pause and (early := last + pause - time.monotonic()) > 0:
                time.sleep(early)
            last = time.monotonic()
            return client.chat(prompt, system_prompt=system_prompt, max_tokens=max_tokens)

        for batch in batches:
            rows = []
            for key, prompt in zip(batch["_key"], batch["prompt"]):
                try:
                    rows.append((key, saved.get(key, lambda: call(prompt)), None))
                except Exception as e:
                    if error_col is None:
                        raise
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "reply", "error"])

    asked = missing.repartition(at_a_time, "_key").mapInPandas(ask, SCHEMA)
    asked.write.mode("append").parquet(f"{ledger}/replies")
    for folder in list_paths(spark, waiting):
        delete_path(spark, folder)
    now = replies(spark, ledger).groupBy("key").agg(F.max_by("reply", F.col("error").isNull()).alias("reply"), F.max_by("error", F.col("error").isNull()).alias("error"))
    told = now.select(F.col("key").alias("_key"), F.col("reply").alias(out_col), *([F.col("error").alias(error_col)] if error_col else []))
    return keyed.join(told, "_key", "left").drop("_key")
