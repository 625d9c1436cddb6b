"""Loaders, streaming ingest, and every query against its SQL."""

from __future__ import annotations

import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.providers import GenAIEmbeddingClient
from tidemark.sources import loaders
from tidemark.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("  hello there \n", "utf-8")
    (tmp_path / "b.csv").write_text("a,b,c\n2,1.50,NA\n3,,x\n", "utf-8")
    (tmp_path / "skip.md").write_text("no", "utf-8")
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    w = "xmlns:w='urn:w'"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:doc {w}><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:doc>")
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<w:s {w}><w:p><w:t>slide {n}</w:t></w:p></w:s>")
    return str(tmp_path)


def test_folder(spark, folder):
    got = loaders.load_documents_to_dataframe(spark, folder).collect()
    assert sorted((r.filename, r.content) for r in got) == [
        ("a.txt", "hello there"), ("b.csv", "2 | 1.5"), ("b.csv", "3 | x"), ("c.docx", "one two\nthree"), ("d.pptx", "slide 2\nslide 10"),
    ]
    assert sorted(r.doc_seq for r in got) == list(range(5))
    failed = loaders.parsed_files(spark, folder).where(F.col("error").isNotNull()).collect()
    assert [r.filename for r in failed] == ["bad.pdf"]


def test_single_document(spark, folder):
    assert [r.content for r in loaders.load_and_process_single_document(spark, folder, "b.csv").collect()] == ["2 | 1.5\n3 | x"]
    assert [r.content for r in loaders.load_and_process_single_document(spark, folder, "a.txt").collect()] == ["  hello there \n"]
    with pytest.raises(ValueError):
        loaders.load_and_process_single_document(spark, folder, "skip.md")
    assert {r.content for r in loaders.linearize_csv(spark, f"{folder}/b.csv").collect()} == {"2 | 1.50 | NA", "3 | x"}


def test_stream_keeps_newest(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "ix")
    client = GenAIEmbeddingClient("hash")

    def arrive(rows):
        spark.createDataFrame(rows, ingest.DOCUMENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.chunked(ingest.documents_stream(spark, source), 20, 0)
        ingest.start_ingest(stream, client, index, str(tmp_path / "cp"), available_now=True).awaitTermination(60)

    arrive([("a", "first version of a text that is long"), ("b", "other")])
    arrive([("a", "second")])
    got = {(r.filename, r.content) for r in ingest.read_latest(spark, index).collect()}
    assert got == {("a", "second"), ("b", "other")}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)


def test_entry_without_llm(tmp_path):
    """The entry module works without the removable parts."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/root"})
