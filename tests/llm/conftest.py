from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, `a.b` int, h long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bdfgklmnprstaeiou") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Ids and texts with nulls, blanks, copies, near copies, repeats of a row and of an id, odd white space and one long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 200)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100, base[3]), (101, base[3]), (102, base[4] + " tail of it"), (103, prose(rng, 40) + " " + base[5][:150] + " " + prose(rng, 40))]
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, base[6]), (None, None), (7, base[7]), (7, base[8]), (-1, base[9])]
    rows += [(300, prose(rng, 6000)), (301, "a  b\n\nc \t d    e<|endoftext|>f"), (302, "x" * 300), (303, "é漢\U0001f600 " * 40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 4}", 0, 0.5, "r", 1, 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
