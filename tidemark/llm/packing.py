"""Pack documents by power-of-two decomposition.

A document of n tokens becomes n // limit pieces of the full length and one
piece per binary digit of the rest, longest first. Each piece is a sequence of
its own, so no sequence crosses documents, and as every length is a power of
two nothing is padded. Equal lengths form a bucket: `bucket` is the length's
exponent, and write_buckets() lays the sequences out by it.

It is one pass over the scan without any shuffle; a hot source, a long document
or copies change nothing but the rows of the task that reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import col, over_texts

SCHEMA = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()),
        ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)


def piece_lengths(n: int, limit: int) -> list[int]:
    """n as pieces of at most limit, a power of two, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_powers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    limit: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece; `ids` holds its little-endian unsigned 32-bit ids.

    A document's ids are its whole text's and then end_id, so null and empty
    texts have that id alone, one piece of length 1. Rows that repeat an id are
    packed each. sequence_id tells the task and the piece within it. No rows in:
    no rows out. Other columns never matter.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = tokenizer_path or bpe.default_path()
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made = bpe.load(path), TaskContext.get().partitionId() << 40, 0
        try:
            yield from pieces(encoder, batches, base, made)
        finally:
            encoder.rest()

    def pieces(encoder, batches: Iterator[pa.RecordBatch], base: int, made: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, limit):
                    piece = ids[4 * start : 4 * (start + length)]
                    for into, value in zip(out, (doc_id, start, length, length.bit_length() - 1, piece, n)):
                        into.append(value)
                    start += length
                held += len(ids)
                if held > 4 << 20:
                    yield _batch(out, base + made)
                    made += len(out[0])
                    out, held = [[] for _ in range(6)], 0
            yield _batch(out, base + made)
            made += len(out[0])

    return over_texts(docs.select(col(id_col).cast("long"), col(text_col).cast("string")), pack, SCHEMA)


def _batch(out: list[list], first: int) -> pa.RecordBatch:
    n = len(out[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip([*out, range(first, first + n), [0] * n], ARROW.types)], schema=ARROW
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences of equal length lie together: one folder per bucket."""
    packed.write.partitionBy("bucket").parquet(path)
