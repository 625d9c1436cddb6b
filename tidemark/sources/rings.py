"""A stored vector index that exact search reads in part: rings around pivots, skipped by triangle bounds.

build() takes some of the vectors as pivots, puts every vector with its nearest
pivot, and packs those of a pivot into blocks by their distance from it. So a
block is a ring: all its vectors lie between two distances from one pivot. A
vector within t of a query is no closer to the pivot than the query is minus t
and no farther than the query is plus t, so a ring beyond those can't hold it.

search() is exact. The best rings of a query's nearest pivot, and the pivots
themselves, give a distance within which its k nearest surely lie; only rings
that this distance reaches are read. What is joined per query and ring is a
number for each; vectors meet only where a ring is read, some hundred queries at
a time. Vectors without structure leave every ring within reach: then as much is
read as by a scan, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept

#: Pivots at most, a constant of the index; bytes of a ring; queries that meet a ring at once; rings tried for a first bound.
PIVOTS, RING_BYTES, TOGETHER, TRIED = 256, 1 << 20, 256, 2
#: By how much, of the lengths involved, computed distances may be off.
SLACK = 1e-9


def _away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all rows of y."""
    return np.sqrt(np.stack([((y - row) ** 2).sum(1) for row in x])) if len(x) else np.empty((0, len(y)))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), float).reshape(-1, dim)


def build(index: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> None:
    """Write the index of (id, vector) rows to path: folders rings and pivots.

    Null vectors are left out. Ids are unique; all vectors have one dimension,
    or it is an error. No rows: an index that finds nothing.
    """
    rows = kept(index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")))
    dims = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("vectors of an index have one dimension")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots)
    middle = [list(r.v) for r in chosen.collect()]
    chosen.select("v").write.mode("overwrite").parquet(f"{path}/pivots")
    dim = dims[0] if dims else 0
    centres = np.array(middle, float).reshape(len(middle), dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            away = _away(x, centres)
            nearest = away.argmin(1) if len(x) else np.empty(0, int)
            columns = [pa.array(nearest, pa.int32()), pa.array(away[np.arange(len(x)), nearest]), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "r", "id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, made, held = max(1, RING_BYTES // (8 * dim)), TaskContext.get().partitionId() << 32, []

        def ring(part: tuple) -> pa.RecordBatch:
            nonlocal made
            pivot, r, ids, x = part
            made += 1
            columns = [[made], [int(pivot[0])], [float(r.min())], [float(r.max())], [len(ids)], [ids.tobytes()], [x.tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["ring", "pivot", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            rows = (*(np.asarray(batch.column(i)) for i in range(3)), _matrix(batch.column(3), dim))
            held = [np.concatenate(c) for c in zip(held, rows)] if len(held) else list(rows)
            while len(held[0]):  # rings end where the pivot changes; the last goes on with the next batch
                end = int(np.searchsorted(held[0], held[0][0], "right"))
                if end == len(held[0]) and end < most:
                    break
                end = min(end, most)
                yield ring(tuple(c[:end] for c in held))
                held = [c[end:] for c in held]
        if len(held) and len(held[0]):
            yield ring(tuple(held))

    placed = rows.mapInArrow(place, "pivot int, r double, id long, v array<double>").repartitionByRange("pivot", "r").sortWithinPartitions("pivot", "r")
    rings = placed.mapInArrow(pack, "ring long, pivot int, low double, high double, n long, ids binary, vectors binary")
    rings.write.mode("overwrite").parquet(f"{path}/rings")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 3, query_id: str = "query_id", query_vector: str = "query_vector", id_col: str = "chunk_id"
) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, distance, ord), (query_id, vectors, read)): the k nearest by squared distance, ties to the smaller id, and the work.

    The same rows as knn_l2_batch() of search.py gives. Null query vectors and
    those of another dimension find nothing.
    """
    middle = [list(r.v) for r in spark.read.parquet(f"{path}/pivots").collect()]  # at most PIVOTS
    dim = len(middle[0]) if middle else 0
    centres = np.array(middle, float).reshape(len(middle), dim)
    rings = spark.read.parquet(f"{path}/rings")
    told, many = rings.select("ring", "pivot", "low", "high", "n"), rings.agg(F.sum("n")).first()[0] or 0
    given = queries.where(F.size(query_vector) == dim).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _away(_matrix(batch.column(1), dim), centres) if dim else np.empty((batch.num_rows, 0))
            within = np.partition(away, k - 1, axis=1)[:, k - 1] if 0 < k <= away.shape[1] else np.full(len(away), np.inf)
            columns = [batch.column(0), batch.column(1), pa.array(list(away), pa.list_(pa.float64())), pa.array(within)]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "v", "away", "within"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, x, asked = np.frombuffer(batch.column(0)[row].as_buffer(), np.int64), np.frombuffer(batch.column(1)[row].as_buffer(), float).reshape(-1, dim), batch.column(2)[row].as_py()
                out = []
                for one in asked:
                    distance = ((x - np.array(one["v"])) ** 2).sum(1)
                    order = np.lexsort((own, distance))[:k]
                    out.append((np.full(len(order), one["q"]), own[order], distance[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "id", "distance"])

    asked = kept(given.mapInArrow(measure, "q long, v array<double>, away array<double>, within double"))
    together = max(1, -(-asked.count() // TOGETHER))

    def read(pairs: DataFrame) -> DataFrame:
        """(q, id, distance): the k best of each pair (q, ring)."""
        groups = pairs.join(asked.select("q", "v"), "q").groupBy("ring", F.pmod(F.xxhash64("q"), F.lit(together)).alias("part"))
        joined = groups.agg(F.collect_list(F.struct("q", "v")).alias("asked")).join(rings, "ring")
        return joined.select("ids", "vectors", "asked").mapInArrow(meet, "q long, id long, distance double")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).where(F.col("ord") <= k)

    gap = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d"))
    reach = asked.select("q", "within", F.posexplode("away").alias("pivot", "d")).join(told, "pivot").withColumn("gap", gap)
    near = Window.partitionBy("q").orderBy("gap", "d", "ring")
    first = reach.join(asked.select("q", F.expr("array_position(away, array_min(away)) - 1").cast("int").alias("pivot")), ["q", "pivot"])
    tried = kept(first.withColumn("at", F.row_number().over(near)).where(F.col("at") <= TRIED).select("q", "ring", "n"))
    seen = kept(ranked(read(tried)))
    bound = seen.where(F.col("ord") == k).select("q", F.sqrt("distance").alias("found"))
    limit = F.least("within", F.coalesce("found", F.lit(float("inf"))))
    slack = SLACK * (F.col("d") + F.col("high"))
    open_ = reach.join(bound, "q", "left").where(F.col("gap") <= limit + slack).select("q", "ring", "n")
    open_ = kept(open_.join(tried.select("q", "ring"), ["q", "ring"], "left_anti"))
    best = ranked(seen.drop("ord").unionByName(read(open_)))
    work = open_.unionByName(tried).groupBy("q").agg(F.sum("n").alias("read"))
    work = work.select(F.col("q").alias(query_id), F.lit(many).cast("long").alias("vectors"), "read")
    return best.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", "ord"), work
