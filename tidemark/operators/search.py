"""Exact nearest neighbours, BM25, and fusion of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.vectors import squared_l2
from ..session import kept

#: Bytes of a block of vectors or term weights.
BLOCK_BYTES = 4 << 20


def knn_l2(index: DataFrame, query: list[float], k: int = 3, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: native, one top-k per task, ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return (
        index.where(F.col(vector_col).isNotNull())
        .withColumn("distance", squared_l2(F.col(vector_col), q))
        .orderBy("distance", id_col)
        .limit(k)
    )


def _blocks(rows: DataFrame) -> DataFrame:
    """(ids, vectors, dim): rows (id long, v array<double>) of a task packed into blocks of at most BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by dimension

        def flush(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            columns = [pa.array([ids.tobytes()]), pa.array([vectors.tobytes()]), pa.array([dim], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "vectors", "dim"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                step = max(1, BLOCK_BYTES // (8 * int(dim)))
                for i in range(0, len(at), step):
                    some = at[i : i + step]
                    held.setdefault(int(dim), []).append((ids[some], flat[begin[some][:, None] + np.arange(dim)]))
                    if sum(len(x) for x, _ in held[int(dim)]) >= step:
                        yield flush(int(dim))
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(run, "ids binary, vectors binary, dim int")


def knn_l2_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = 3,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """(query_id, id, distance, ord): k nearest rows for each of many queries, squared L2, ord from 1.

    Both sides are packed into blocks of bounded bytes where they are, and each
    block of queries meets each block of the index in some task, which returns
    its k best per query: what is shuffled after that is k rows per query and
    block, never distances of pairs. Blocks meet without a key, as pairs of
    partitions: a key such as the dimension, which all vectors share, would send
    every block to one task. Nothing passes through the driver. With fewer than
    k rows all are returned; blocks of different dimensions give nothing.
    """
    rows = index.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_dim = batch.column(4)[row].as_py(), batch.column(5)[row].as_py()
                if dim != q_dim:
                    continue
                own, x, ids, q = (
                    np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in enumerate((np.int64, float, np.int64, float))
                )
                x, q = x.reshape(-1, dim), q.reshape(-1, dim)
                squares, out = (x**2).sum(1), []
                for i in range(0, len(q), 256):
                    rough = (q[i : i + 256] ** 2).sum(1)[:, None] - 2 * q[i : i + 256] @ x.T + squares
                    for j, given in enumerate(rough, i):
                        near = np.arange(len(given))
                        if len(given) > k:
                            limit = np.partition(given, k - 1)[k - 1]
                            near = np.flatnonzero(given <= limit + 1e-9 * max(1.0, abs(limit), float(squares.max())))
                        exact = np.add.accumulate((x[near] - q[j]) ** 2, axis=1)[:, -1]  # one by one, as SQL adds, so that the last bit agrees
                        order = np.lexsort((own[near], exact))[:k]
                        out.append((np.full(len(order), ids[j]), own[near][order], exact[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "id", "distance"])

    of_query = _blocks(asked).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dim").alias("q_dim"))
    met = _blocks(rows).crossJoin(of_query)  # of blocks, not of rows
    found = met.select("ids", "vectors", "q_ids", "q_vectors", "dim", "q_dim").mapInArrow(search, "q long, id long, distance double")
    by_query = Window.partitionBy("q").orderBy("distance", "id")
    return (
        found.withColumn("ord", F.row_number().over(by_query))
        .where(F.col("ord") <= k)
        .select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", "ord")
    )


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 3,
    id_col: str = "chunk_id",
    text_col: str = "content",
    query_id: str = "query_id",
    query_text: str = "question",
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """(query_id, id, score, ord): BM25 (Robertson and Zaragoza, 2009), ties to the smaller id.

    Texts are tokenized once into the counts of terms that questions ask for,
    which are written to the shared folder for the two passes over them. A task packs its
    texts' weights into blocks; blocks of texts meet blocks of questions, which
    return their k best per question. So a word that all texts hold and all
    questions ask for costs additions in place, not a row for each pair.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("q"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term")).where("q is not null")
    wanted = asked.select("term").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    counts = kept(
        texts.select("id", F.size("terms").alias("length"), F.explode_outer("terms").alias("term"))
        .join(wanted.withColumn("wanted", F.lit(True)), "term", "left")
        .groupBy("id", "length", F.when(F.col("wanted"), F.col("term")).alias("term"))
        .agg(F.count("*").alias("tf"))
    )
    lengths = counts.select("id", "length").distinct()
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    held = counts.where(F.col("term").isNotNull())
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    weights = held.join(df, "term").crossJoin(F.broadcast(size)).select("id", F.xxhash64("term").alias("t"), part.alias("w"))
    of_text = weights.groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("x"))
    text_blocks = _packed(of_text.select("id", F.col("x.t").alias("t"), F.col("x.w").alias("w")))
    # sorted: the same sum, to the last bit, for texts of the same weights, whichever blocks they are in
    of_query = asked.groupBy("q").agg(F.sort_array(F.collect_list(F.xxhash64("term"))).alias("t"))
    query_blocks = _packed(of_query.select(F.col("q").alias("id"), "t", F.transform("t", lambda _: F.lit(1.0)).alias("w")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, t, w, q, q_sizes, q_t = (
                    np.frombuffer(batch.column(i)[row].as_buffer(), kind)
                    for i, kind in enumerate((np.int64, np.int64, np.int64, float, np.int64, np.int64, np.int64))
                )
                order = np.argsort(t, kind="stable")
                sorted_t, of, sorted_w = t[order], np.repeat(np.arange(len(ids)), sizes)[order], w[order]
                begin, end = np.searchsorted(sorted_t, q_t, "left"), np.searchsorted(sorted_t, q_t, "right")
                out, ends = [], np.cumsum(q_sizes)
                for name, i, j in zip(q, ends - q_sizes, ends):
                    at = [slice(x, y) for x, y in zip(begin[i:j], end[i:j]) if x < y]
                    if not at:
                        continue
                    who = np.concatenate([of[s] for s in at])
                    score = np.bincount(who, np.concatenate([sorted_w[s] for s in at]), len(ids))
                    near = np.unique(who)
                    if len(near) > k:
                        limit = np.partition(score[near], len(near) - k)[len(near) - k]
                        near = near[score[near] >= limit - 1e-8]
                    near = near[np.lexsort((ids[near], -np.round(score[near], 9)))][:k]
                    out.append((np.full(len(near), name), ids[near], score[near]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["q", "id", "score"])

    asking = query_blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "t")])
    found = text_blocks.crossJoin(asking).mapInArrow(search, "q long, id long, score double")  # of blocks, not of rows
    by_query = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    return (
        found.withColumn("ord", F.row_number().over(by_query))
        .where(F.col("ord") <= k)
        .select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "ord")
    )


def _packed(rows: DataFrame) -> DataFrame:
    """(ids, sizes, t, w): rows (id, t array<long>, w array<double>) of a task packed into blocks of at most BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([np.concatenate(x).tobytes()]) for x in zip(*held)]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "t", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((batch.column(0).to_numpy(), sizes, *(batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))))
            size += 16 * (len(sizes) + int(sizes.sum()))
            if size >= BLOCK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(run, "ids binary, sizes binary, t binary, w binary")


def fuse(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.5, k: int | None = None, score: str = "distance") -> DataFrame:
    """Weighted fusion of (query_id, content, score, ord) tables: alpha * semantic + (1 - alpha) * keyword.

    Texts are the key. Of a text's semantic hits the last scores and the first
    places it; keyword hits add up. score="distance" takes semantic scores as
    they come, so that far texts rank first; "similarity" turns them into
    1 / (1 + distance). Ties keep semantic order, then keyword order.
    """
    given = F.col("score") if score == "distance" else 1 / (1 + F.col("score"))
    left = semantic.groupBy("query_id", "content").agg(
        F.max_by(given, "ord").alias("s"), F.min("ord").cast("long").alias("s_ord")
    )
    right = keyword.groupBy("query_id", "content").agg(F.sum("score").alias("w"), F.min("ord").cast("long").alias("w_ord"))
    both = (
        left.join(right, ["query_id", "content"], "full_outer")
        .withColumn("score", alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0)))
        .withColumn("place", F.coalesce("s_ord", F.col("w_ord") + (1 << 32)))
    )
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    ranked = both.withColumn("ord", F.row_number().over(by_query)).select("query_id", "content", "score", "ord")
    return ranked if k is None else ranked.where(F.col("ord") <= k)
