"""Token counts by offset-mapped attribution.

A record's fields are joined and encoded whole, once. The tokens' byte offsets
are then joined as intervals with the sections (fields, and lines within them),
so counts add up to the record's own length, which counts of sections encoded
one by one don't. A token that crosses a boundary goes to one section by an
explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import col, over_texts

SCHEMA = (
    "doc_id long, n_tokens long, n_sections long, n_crossing long, "
    "field_tokens array<long>, section_tokens array<long>"
)
RULES = ("first", "last", "most")


def attribute(widths: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    widths: bytes of each token in order. starts: where sections begin, the
    first at 0, ascending. first: the section of a token's first byte; last: of
    its last byte; most: the one with most of its bytes, the earlier of equals.
    """
    end = np.cumsum(widths)
    begin = end - widths
    head = np.searchsorted(starts, begin, "right") - 1
    tail = np.searchsorted(starts, end - 1, "right") - 1
    crossing = np.flatnonzero(head != tail)
    where = tail.copy() if rule == "last" else head.copy()
    if rule == "most":
        for t in crossing:
            cuts = np.concatenate([[begin[t]], starts[head[t] + 1 : tail[t] + 1], [end[t]]])
            where[t] = head[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(where, minlength=len(starts)), len(crossing)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("text",),
    tokenizer_path: str | None = None,
    rule: str = "first",
) -> DataFrame:
    """One row per row of docs: tokens in all, per field and per section.

    Fields are joined by one newline, which belongs to the field before it, and
    a section is a line with the newline that ends it. Null fields are empty; a
    record without a character has no tokens, no sections and fields of 0.
    Repeated rows are counted each; one pass, no shuffle. No rows in: no rows
    out. Other columns never matter.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, n_fields = tokenizer_path or bpe.default_path(), len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(path)
        for batch in batches:
            rows = []
            for parts in zip(*(batch.column(1 + i).to_pylist() for i in range(n_fields))):
                text = "\n".join(p or "" for p in parts)
                if not text:
                    rows.append((0, 0, 0, [0] * n_fields, []))
                    continue
                widths = encoder.widths[np.frombuffer(encoder.encode(text), "<u4")]
                raw = np.frombuffer(text.encode(), np.uint8)
                lines = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                lines = lines[lines < len(raw)]
                sections, crossing = attribute(widths, lines, rule)
                if n_fields == 1:
                    by_field = [len(widths)]
                else:
                    sizes = [len((p or "").encode()) + 1 for p in parts]
                    by_field, _ = attribute(widths, np.concatenate([[0], np.cumsum(sizes[:-1])]), rule)
                rows.append((len(widths), len(lines), crossing, list(map(int, by_field)), sections.tolist()))
            n, s, c, f, by = zip(*rows) if rows else [[]] * 5
            long, longs = pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, long), pa.array(s, long), pa.array(c, long), pa.array(f, longs), pa.array(by, longs)],
                names=["doc_id", "n_tokens", "n_sections", "n_crossing", "field_tokens", "section_tokens"],
            )

    rows = docs.select(col(id_col).cast("long").alias("id"), *[col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return over_texts(rows, run, SCHEMA)
