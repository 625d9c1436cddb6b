"""Connected components of an edge table, without collecting any of it.

Alternating large-star and small-star rounds (Kiveris et al., 2014). Every
round is two group-bys with map-side minima; its result is written to the
shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): hang neighbours v of u, and u itself, from the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u")
    if larger_only:
        hung = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return hung.where(F.col("u") != F.col("v")).distinct()


def settled(pairs: DataFrame) -> bool:
    """Whether distinct pairs (u, v), u > v, are stars: every u hangs from one node, which hangs from none."""
    twice = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    between = pairs.select(F.col("v").alias("u")).distinct().join(pairs.select("u"), "u", "left_semi")
    return not twice.unionByName(between).take(1)


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) in any order to stars: every node but a component's least, with that least.

    Nodes without an edge to another don't appear. Nulls may not occur.
    """
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    for _ in range(most_rounds):
        if settled(now):
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = cut(_star(cut(_star(both, True)), False))
    raise RuntimeError("components didn't settle")
