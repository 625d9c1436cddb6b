"""Question-answer pairs from model replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_json_array, lenient_json_array

PAIR = "array<map<string,string>>"


def qa_pairs(replies: DataFrame, batch_col: str = "batch", reply_col: str = "reply", max_total: int | None = None, lenient: bool = False) -> DataFrame:
    """(batch, pos, pair): the pairs in each reply's JSON array; replies without a valid one give none.

    The array ends at the first ']', be it inside an answer; lenient takes the
    one that closes it. ground_truth is renamed to 'ground truth' and wins over a key spelt so.
    max_total caps pairs over all batches in order.
    """
    parsed = F.from_json((lenient_json_array if lenient else first_json_array)(F.col(reply_col)), PAIR)
    rows = replies.select(F.col(batch_col).alias("batch"), F.posexplode(parsed).alias("pos", "pair"))
    renamed = F.map_concat(
        F.map_filter("pair", lambda key, _: ~key.isin("ground_truth", "ground truth")),
        F.when(
            F.map_contains_key("pair", "ground_truth") | F.map_contains_key("pair", "ground truth"),
            F.create_map(
                F.lit("ground truth"),
                F.when(F.map_contains_key("pair", "ground_truth"), F.col("pair")["ground_truth"]).otherwise(F.col("pair")["ground truth"]),
            ),
        ).otherwise(F.create_map().cast("map<string,string>")),
    )
    out = rows.where(F.col("pair").isNotNull()).withColumn("pair", renamed)
    if max_total is None:
        return out
    return out.orderBy("batch", "pos").limit(max_total)  # each task sends its first max_total at most


def qa_frame(pairs: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(question, ground truth, and a column for each key in more) in order of batch and position."""
    return pairs.orderBy("batch", "pos").select(*[F.col("pair")[k].alias(k) for k in ("question", "ground truth", *more)])


def other_keys(pairs: DataFrame, most: int = 1000) -> list[str]:
    """Keys that replies gave beside question and ground truth, in order; more than `most` are no columns and an error."""
    found = pairs.select(F.explode(F.map_keys("pair")).alias("key")).where(~F.col("key").isin("question", "ground truth"))
    keys = [r["key"] for r in found.distinct().orderBy("key").limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"replies have more than {most} different keys")
    return keys
