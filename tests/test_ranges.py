"""CSV by byte ranges gives the rows of reading files at once."""

from __future__ import annotations

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.sources import loaders, ranges

FILES = {
    "quotes.csv": 'a,b,c\n1,"x\ny, ""z""\n\n",2\n3,5" pipe,4\n5,"",6\n\n7,"q""",8\r\n9,"end\n' + '"' + ",10\n" + '11,"a\n1,""b"",2\n"x,12\n',
    "types.csv": "i,f,n,t,b,o\n" + "".join(f"0{k},{k}.50,{'' if k == 30 else k},{'x' if k == 39 else k},True,{'1.5' if k > 20 else 'true'}\n" for k in range(40)),
    "large.csv": "u,v\n18446744073709551615,18446744073709551615\n" + "".join(f"{k},{-k}\n" for k in range(20)),
    "named.csv": "a,b\n" + "".join(f"r{k},{k},{k + 1}\n" for k in range(9)),
    "long.csv": "a,b\n1," + "y" * 500 + '\n2,"' + "z\n" * 200 + '"\n3,e',
    "twice.csv": "a,a,\n" + "1,2,3\n" * 9,
    "header.csv": "a,b\n",
    "empty.csv": "",
    "ragged.csv": "a,b\n" + "1,2\n" * 20 + "1,2,3,4\n" + "1,2\n" * 20,
    "marked.csv": "﻿a,b\n1,ü\n2,\n",
    "open.csv": 'a,b\n1,2\n3,"never closed\n' + "4,5\n" * 30,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("ranges")
    for name, text in FILES.items():
        (path / name).write_bytes(text.encode())
    (path / "latin.csv").write_bytes(b"a,b\n" + b"1,2\n" * 30 + b"\xff\xfe,3\n")
    (path / "other.txt").write_text("no table", "utf-8")
    return str(path)


def at_once(folder):
    want = {}
    for name in [*FILES, "latin.csv"]:
        with open(f"{folder}/{name}", "rb") as f:
            try:
                want[name] = loaders.parse_file(name, f.read())
            except Exception:
                want[name] = None
    return want


@pytest.mark.parametrize("size", [31, 1 << 20])
def test_rows_are_those_of_whole_files(spark, folder, size):
    files = ranges.file_ranges(spark, folder, size).where(F.col("filename").endswith(".csv"))
    got = ranges.csv_rows(spark, files).collect()
    for name, want in at_once(folder).items():
        rows = sorted((r.part, r.content, r.error is None) for r in got if r.filename == name)
        if want is None:
            assert [(p, c, ok) for p, c, ok in rows] == [(0, None, False)], name
        else:
            assert rows == [(i, text, True) for i, (_, text) in enumerate(want)], name
    assert {r.filename for r in got} <= {*FILES, "latin.csv"}


def test_random_tables_with_quotes(spark, tmp_path):
    rng = random.Random(3)
    for n in range(12):
        fields = lambda: "".join(rng.choice(['"', ",", "\n", "a", " ", "\r\n", '""']) for _ in range(rng.randrange(9)))
        pd.DataFrame([[k, fields(), fields()] for k in range(60)], columns=list("abc")).to_csv(tmp_path / f"{n}.csv", index=False)
    got = ranges.csv_rows(spark, ranges.file_ranges(spark, str(tmp_path), 97)).collect()
    for n in range(12):
        want = loaders.parse_file("x.csv", (tmp_path / f"{n}.csv").read_bytes())
        assert [r.content for r in sorted((r for r in got if r.filename == f"{n}.csv"), key=lambda r: r.part)] == [t for _, t in want]


def test_a_line_begins_in_one_range_only():
    raw = b"one\n\ntwo and more\nthree"
    for size in range(1, 12):
        cuts = [ranges.line_start(io.BytesIO(raw), at, len(raw)) for at in range(0, len(raw), size)]
        assert cuts == sorted(cuts) and {c for c in cuts if c < len(raw)} <= {0, 4, 5, 18}


def test_names_are_looked_at_while_listing_and_tasks_share_ranges(spark, folder):
    files = ranges.file_ranges(spark, folder, 64).where("filename = 'types.csv'")
    assert "PushedFilters: [EqualTo(filename,types.csv)]" in files._jdf.queryExecution().toString() or files.count() > 1
    assert {r.filename for r in files.collect()} == {"types.csv"}
    assert files.rdd.getNumPartitions() == files.count() > 5
    small = ranges.file_ranges(spark, folder)
    assert small.rdd.getNumPartitions() == 1 and small.count() == len(FILES) + 2
    assert ranges.file_ranges(spark, folder, 64, larger_than=10**6).count() == 0


def test_the_loader_takes_large_files_by_ranges(spark, folder):
    want = sorted((r.filename, r.doc_seq, r.content) for r in loaders.load_documents_to_dataframe(spark, folder).collect())
    got = sorted((r.filename, r.doc_seq, r.content) for r in loaders.load_documents_to_dataframe(spark, folder, range_bytes=100).collect())
    assert got == want and len(want) == 91
    errors = lambda size: sorted(r.filename for r in loaders.parsed_files(spark, folder, size).where("error IS NOT NULL").collect())
    assert errors(100) == errors(1 << 20)
