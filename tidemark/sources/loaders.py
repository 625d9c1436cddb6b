"""Folders of documents as frames.

Files are listed and read by Spark's binaryFile source, so any store Spark
reads will do, and parsed a file at a time on the executors, but for large CSV
files, which ranges.py reads in parts. What can't be
parsed goes to an error column instead of ending the load. Word, PowerPoint and
xlsx files are read from their XML with the standard library, old xls files by
xls.py, PDF files by pdf.py, a page at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import linearize
from ..operators.chunking import explode_chunks, split_text
from .pdf import pdf_texts
from .ranges import RANGE_BYTES, SCHEMA, csv_rows, file_ranges
from .xls import DATE_FORMATS, as_date, shows_date, xls_sheets

SUPPORTED = ("pdf", "txt", "csv", "xls", "xlsx", "docx", "pptx")


def _csv_rows(raw: bytes) -> list[str]:
    """Values as pandas types them, joined; nulls are left out."""
    frame = pd.read_csv(io.BytesIO(raw), low_memory=False)  # types are those of whole columns
    return [" | ".join(str(v) for v in row if pd.notna(v)) for row in frame.itertuples(index=False, name=None)]


def _xml_texts(raw: bytes, names: str, block: str) -> list[str]:
    """For each part of an Office file: its paragraphs' texts, a line each."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    parts = sorted((n for n in archive.namelist() if re.fullmatch(names, n)), key=lambda n: [int(d) for d in re.findall(r"\d+", n)])
    out = []
    for name in parts:
        root = ElementTree.fromstring(archive.read(name))
        blocks = [b for b in root.iter() if b.tag.rpartition("}")[2] == block]
        lines = ["".join(t.text or "" for t in b.iter() if t.tag.rpartition("}")[2] == "t") for b in blocks]
        out.append("\n".join(line for line in lines if line))
    return out


def _column(reference: str) -> int:
    """A cell's column from 0, of a reference such as AB12."""
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = 26 * n + ord(letter.upper()) - 64
    return n - 1


def _dated(archive: zipfile.ZipFile) -> list[bool]:
    """Of each cell style, whether it shows numbers as dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    styles = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): shows_date(f.get("formatCode", "")) for f in styles.iter() if f.tag.endswith("}numFmt")}
    kinds = [int(x.get("numFmtId", 0)) for of in styles if of.tag.endswith("}cellXfs") for x in of]
    return [own.get(k, k in DATE_FORMATS) for k in kinds]


def _cell(cell: ElementTree.Element, shared: list[str], dated: list[bool], from_1904: bool):
    """A cell's value as text, number, truth, time or None."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if t.tag.endswith("}t"))
    raw = next((v.text for v in cell if v.tag.endswith("}v")), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind in ("str", "e"):
        return raw
    if kind == "b":
        return raw == "1"
    value, style = float(raw), int(cell.get("s", 0))
    if style < len(dated) and dated[style]:
        return as_date(value, from_1904)
    return int(value) if value.is_integer() else value


def _sheets(raw: bytes) -> list[tuple[str, str]]:
    """(name, table as text) of each sheet of an xlsx workbook."""
    archive = zipfile.ZipFile(io.BytesIO(raw))
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out, dated, book = [], _dated(archive), ElementTree.fromstring(archive.read("xl/workbook.xml"))
    from_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter() if x.tag.endswith("}workbookPr"))
    for sheet in (x for x in book.iter() if x.tag.endswith("}sheet")):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        rows = []
        for row in (x for x in ElementTree.fromstring(archive.read(path)).iter() if x.tag.endswith("}row")):
            at = int(row.get("r", len(rows) + 1)) - 1
            rows += [{} for _ in range(at + 1 - len(rows))]
            for n, cell in enumerate(c for c in row if c.tag.endswith("}c")):
                rows[at][_column(cell.get("r")) if cell.get("r") else n] = _cell(cell, shared, dated, from_1904)
        out.append((sheet.get("name"), table_text(rows)))
    return out


def table_text(rows: list[dict]) -> str:
    """A sheet's rows, which hold cells by column, as text; the first row is the header."""
    width = 1 + max((max(r, default=-1) for r in rows), default=-1)
    table = [[r.get(i) for i in range(width)] for r in rows]
    header = [f"Unnamed: {i}" if h is None else h for i, h in enumerate(table[0])] if table else []
    return pd.DataFrame(table[1:], columns=header).infer_objects().to_string(index=False)


def parse_file(name: str, raw: bytes) -> list[tuple[str, str]]:
    """(name, text) of each record of a file: a CSV row, a sheet, or the whole. PDF files are pdf.py's."""
    kind = name.lower().rpartition(".")[2]
    if kind == "csv":
        return [(name, r) for r in _csv_rows(raw)]
    if kind in ("xls", "xlsx"):
        named = _sheets(raw) if zipfile.is_zipfile(io.BytesIO(raw)) else [(sheet, table_text(rows)) for sheet, rows in xls_sheets(raw)]
        return [(f"{name}::{sheet}", text) for sheet, text in named]
    if kind == "txt":
        return [(name, raw.decode("utf-8").strip())]
    if kind == "docx":
        return [(name, "\n".join(_xml_texts(raw, r"word/document\.xml", "p")).strip())]
    if kind == "pptx":
        return [(name, "\n".join(_xml_texts(raw, r"ppt/slides/slide\d+\.xml", "p")).strip())]
    raise ValueError(f"unsupported file type: {name}")


def parsed_files(spark: SparkSession, folder_path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(filename, part, content, error) of all supported files right in the folder. CSV files of more than range_bytes are read by ranges."""
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in SUPPORTED) + "}"  # in any case
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder_path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["filename"], batch["content"]):
                try:
                    rows += [(n, i, text, None) for i, (n, text) in enumerate(parse_file(name, raw))]
                except Exception as e:
                    rows.append((name, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["filename", "part", "content", "error"])

    by_ranges = F.lower("path").endswith(".csv") & (F.col("length") > range_bytes)
    named = files.where(~by_ranges).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    is_pdf = F.lower("filename").endswith(".pdf")
    parsed = named.where(~is_pdf).mapInPandas(parse, SCHEMA).unionByName(pdf_texts(named.where(is_pdf)).withColumn("part", F.col("part").cast("long")))
    if files.where(by_ranges).select("length").isEmpty():
        return parsed
    large = file_ranges(spark, folder_path, range_bytes, larger_than=range_bytes).where(F.lower("filename").endswith(".csv"))
    return parsed.unionByName(csv_rows(spark, large))


def load_documents_to_dataframe(spark: SparkSession, folder_path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_seq, filename, content): every record of a folder's files; a file's records stay in order and together.

    A folder without such files gives no rows; one that isn't there fails and
    isn't made. Files that can't be read are left out: parsed_files() tells why.
    """
    good = parsed_files(spark, folder_path, range_bytes).where(F.col("error").isNull())
    from ..operators.ordering import with_running_sum

    per_file = good.groupBy("filename").agg(F.count("*").alias("n")).withColumn("_h", F.xxhash64("filename"))
    first = with_running_sum(per_file, "_h", F.col("n"), "_first").select("filename", "_first")
    return good.join(first, "filename").select(
        (F.col("_first") + F.when(F.col("filename").contains("::"), 0).otherwise(F.col("part"))).alias("doc_seq"), "filename", "content"
    )


def load_and_process_single_document(
    spark: SparkSession, folder_path: str, filename: str, max_chars: int = 1000, overlap: int = 100
) -> DataFrame:
    """(filename, chunk_id, content) of one .pdf, .txt or .csv file.

    A file that isn't there is a FileNotFoundError, one of another type or that
    can't be read a ValueError; both are raised here, so the file is parsed now,
    by an executor, and only its chunks are kept.
    """
    kind = filename.lower().rpartition(".")[2]
    files = spark.read.format("binaryFile")
    try:
        files = files.load(f"{folder_path.rstrip('/')}/{filename}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {folder_path}/{filename}") from None
        raise
    if kind not in ("pdf", "txt", "csv"):
        raise ValueError(f"Error reading {filename}: unsupported file type")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch["content"]:
                try:
                    texts.append(raw.decode("utf-8") if kind == "txt" else "\n".join(_csv_rows(raw)))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"filename": filename, "content": texts, "error": errors})

    if kind == "pdf":  # the pages' texts, joined as they follow each other
        pages = pdf_texts(files.select(F.lit(filename).alias("filename"), "content")).groupBy("filename")
        whole_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: p["content"]), "")
        read = pages.agg(whole_text.alias("content"), F.max("error").alias("error"))
    else:
        read = files.select("content").mapInPandas(whole, "filename string, content string, error string")
    read = read.persist()
    if bad := read.where(F.col("error").isNotNull()).first():
        read.unpersist()
        raise ValueError(f"Error reading {filename}: {bad['error']}")
    return explode_chunks(read, split_text(F.col("content"), max_chars, overlap), "filename")


def linearize_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of raw CSV strings joined natively; unlike the loader it re-types nothing."""
    rows = spark.read.csv(path, header=True)
    return rows.select(linearize(*[F.col(f"`{c}`") for c in rows.columns]).alias("content"))
