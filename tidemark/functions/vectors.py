"""Vector expressions in double precision."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, terms

HASH_DIM = 64


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def hash_embedding(text: Column, dim: int = HASH_DIM) -> Column:
    """Feature-hashed term counts at unit length: an embedding that needs no model.

    A term's slot is the first 8 hex digits of its md5 modulo dim. Texts without
    terms give zeros.
    """
    slots = F.transform(terms(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim)
    places = F.sequence(F.lit(0), F.lit(dim - 1))

    def count(held: Column) -> Column:
        # array_remove is a plain loop over longs; a lambda would be interpreted for every term and place
        return F.transform(places, lambda i: (F.size(held) - F.size(F.array_remove(held, i))).cast("double"))

    def unit(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return let(norm, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return let(let(slots, count), unit)


def hash_vector(text: str, dim: int = HASH_DIM) -> list[float]:
    """hash_embedding() of one text in plain Python."""
    counts = [0.0] * dim
    for term in re.findall(r"[^\W_]+", text.lower()):
        counts[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = sum(x * x for x in counts) ** 0.5
    return [x / norm for x in counts] if norm else counts
