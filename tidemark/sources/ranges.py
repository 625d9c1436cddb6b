"""Large CSV files read by byte ranges, with the rows of reading each at once.

The source file_ranges lists a folder as ranges of its files; conditions on the
file name are applied while it lists, and small files share a task. A range
owns the records that begin in it. Whether it begins inside a quoted field only
the ranges before it tell, so a first pass finds for either case where the
range's first record begins and how the range ends; a window composes these, two
numbers a range. A second pass finds each column's types, which pandas takes from
all of a file's values, and the third makes the rows. Each reads one range at a
time; of a file only these few numbers a range meet.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..session import kept

SCHEMA = "filename string, part long, content string, error string"
#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: Rows parsed, and sent to Spark, at a time.
BATCH_ROWS = 5_000
#: Tasks of a pass over ranges, at most; a task takes one range after the other.
MOST_TASKS = 100_000

#: A quote that opens a field: it stands first in it.
OPENS = re.compile(rb'(?:\A|[,\r\n])"')


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


class FileRanges(DataSource):
    """Ranges of the files right in a folder: options path, range_bytes, and larger_than, which leaves files of at most so many bytes out."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, filename string, size long, n int, lo long, hi long"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(dict(self.options))


class _Ranges(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


#: How a condition on the file name that Spark hands down is told.
TESTS = {
    EqualTo: lambda name, f: name == f.value,
    In: lambda name, f: name in f.value,
    StringStartsWith: lambda name, f: name.startswith(f.value),
    StringEndsWith: lambda name, f: name.endswith(f.value),
}


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.larger_than, self.tests = int(options.get("larger_than", -1)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("filename",):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(folder))
        files = sorted((f for f in found if f.is_file and f.size > self.larger_than), key=lambda f: f.base_name)
        files = [f for f in files if all(TESTS[type(t)](f.base_name, t) for t in self.tests)]
        out, held, at = [], 0, []
        for f in files:
            for n in range(max(1, -(-f.size // self.bytes))):
                lo, hi = n * self.bytes, min((n + 1) * self.bytes, f.size)
                at.append((f"{self.folder.rstrip('/')}/{f.base_name}", f.base_name, f.size, n, lo, hi))
                held += hi - lo
                if held >= self.bytes:
                    out.append(_Ranges(at))
                    held, at = 0, []
        return out + [_Ranges(at)] if at or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows


def file_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, larger_than: int = -1) -> DataFrame:
    """(path, filename, size, n, lo, hi) of a folder's files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark's way to let Python sources see conditions
    spark.dataSource.register(FileRanges)
    options = {"range_bytes": range_bytes, "larger_than": larger_than}
    return spark.read.format(FileRanges.name()).options(**options).load(folder)


def line_start(handle, at: int, size: int) -> int:
    """The first place from `at` on where a line begins; size, if none does."""
    if at == 0:
        return 0
    handle.seek(at - 1)
    place = at - 1
    while piece := handle.read(1 << 16):
        found = piece.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(piece)
    return size


def _closed(body: bytes, at: int) -> int:
    """Behind the quote that closes the field that goes on at `at`; -1, if none does."""
    while (at := body.find(b'"', at)) >= 0 and body[at + 1 : at + 2] == b'"':
        at += 2
    return at + 1 if at >= 0 else -1


def ends_quoted(body: bytes, quoted: bool) -> bool:
    """Whether lines that begin inside a quoted field, or not, end inside one."""
    at = 0
    while True:
        if quoted and (at := _closed(body, at)) < 0:
            return True
        opened = OPENS.search(body, at)
        if not opened:
            return False
        at, quoted = opened.end(), True


def first_record(body: bytes) -> int | None:
    """Where the first record begins in lines that begin inside a quoted field; none, if none does."""
    at = _closed(body, 0)
    while at >= 0:
        line, opened = body.find(b"\n", at), OPENS.search(body, at)
        if line < 0:
            return None
        if not opened or line <= opened.start():
            return line + 1 if line + 1 < len(body) else None
        at = _closed(body, opened.end())
    return None


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, name, size, n, lo, hi in batch.itertuples(index=False, name=None):
            store, inside = _store(path)
            with store.open_input_file(inside) as f:
                start, stop = line_start(f, lo, size), line_start(f, hi, size) if hi < size else size
                if start < stop or n == 0:
                    f.seek(start)
                    body = f.read(stop - start)
                    first = first_record(body)
                    ends = ends_quoted(body, False), ends_quoted(body, True)
                    rows.append((path, name, size, n, start, None if first is None else start + first, *ends))
        yield pd.DataFrame(rows, columns=SCANNED_NAMES).astype({"begin_quoted": "Int64"})


SCANNED = "path string, filename string, size long, n int, begin long, begin_quoted long, ends boolean, ends_quoted boolean"
SCANNED_NAMES = [c.split()[0] for c in SCANNED.split(", ")]


def _records(scanned: DataFrame) -> DataFrame:
    """(path, filename, n, begin, end, sample_end): each range's records as bytes of its file.

    A range maps how it begins to how it ends: to one end whatever the beginning
    (then nothing before it matters), to the same, or to the other.
    """
    along = Window.partitionBy("path").orderBy("n")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("ends") == F.col("ends_quoted"), (F.col("ends") & ~F.col("ends_quoted")).cast("int")
    known = scanned.withColumn("turned", F.sum(turns).over(along)).withColumn("fixed", F.when(fixed, F.struct("ends", "turned")))
    last = F.last("fixed", ignorenulls=True).over(before)
    turned = F.coalesce(F.sum(turns).over(before), F.lit(0)) - F.coalesce(last["turned"], F.lit(0))
    inside = F.coalesce(last["ends"], F.lit(False)).cast("int") + turned
    begins = known.withColumn("begin", F.when(inside % 2 == 1, F.col("begin_quoted")).otherwise(F.col("begin"))).where("begin IS NOT NULL")
    return begins.select(
        "path", "filename", "n", "begin",
        F.coalesce(F.lead("begin").over(along), "size").alias("end"),
        F.coalesce(F.lead("begin", 2).over(along), "size").alias("sample_end"),
    )


def _bytes(path: str, begin: int, end: int) -> bytes:
    store, inside = _store(path)
    with store.open_input_file(inside) as f:
        f.seek(begin)
        return f.read(end - begin)


def _headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a file's beginning: all its columns' names, and how many of the first are row names, which pandas takes when rows are longer than the header."""
    for batch in batches:
        rows = []
        for path, end in zip(batch["path"], batch["sample_end"]):
            try:
                head = pd.read_csv(io.BytesIO(_bytes(path, 0, end)), nrows=1, low_memory=False)
                led = 0 if isinstance(head.index, pd.RangeIndex) else head.index.nlevels
                rows.append((path, [f"row {i}" for i in range(led)] + [str(c) for c in head.columns], led, None))
            except Exception as e:
                rows.append((path, [], 0, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "names", "led", "head_error"])


def _frames(path: str, begin: int, end: int, names: list[str], led: int, dtype: dict | None) -> Iterator[pd.DataFrame]:
    """A range's records, some rows at a time, without row names."""
    body = _bytes(path, begin, end)
    if begin and not body.strip(b"\r\n"):  # blank lines only
        return
    # columns by number, as pandas would have a dtype for each of two names that are equal
    given = pd.read_csv(
        io.BytesIO(body), header=None if begin else 0, names=range(len(names)), dtype=dtype, chunksize=BATCH_ROWS, low_memory=False, encoding="utf-8"
    )
    for frame in given:
        if not isinstance(frame.index, pd.RangeIndex):
            raise ValueError(f"more than {len(names)} fields")
        yield frame.iloc[:, led:]


#: What a column's values are, as bits.
NULL, INTEGER, NEGATIVE, LARGE, FLOAT, BOOLEAN, TEXT = (1 << i for i in range(7))


def kind_of(values: pd.Series) -> int:
    """Bits of what some values of a column are, by how pandas takes them."""
    bits = NULL if values.isna().any() else 0
    if values.isna().all():
        return bits
    kind = values.dtype.kind
    if kind == "i":
        return bits | INTEGER | (NEGATIVE if values.min() < 0 else 0)
    if kind in "ufb":
        return bits | {"u": LARGE, "f": FLOAT, "b": BOOLEAN}[kind]
    return bits | (BOOLEAN if pd.api.types.infer_dtype(values, skipna=True) == "boolean" else TEXT)


def dtype_of(bits: int) -> str | None:
    """How pandas takes a column with all these values; None where each range's own way is the same."""
    numbers = bits & (INTEGER | LARGE | FLOAT)
    if bits & TEXT or (bits & BOOLEAN and numbers):
        return "str"
    if bits & FLOAT or (numbers == INTEGER and bits & NULL):
        return "float64"
    if bits & LARGE:
        return "str" if bits & (NULL | NEGATIVE) else "uint64"
    return "int64" if numbers else None


def _typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, n, begin, end, names, led in batch.itertuples(index=False, name=None):
            bits, count, error = [0] * (len(names) - led), 0, None
            try:
                for frame in _frames(path, begin, end, names, led, None):
                    count += len(frame)
                    bits = [b | kind_of(frame.iloc[:, i]) for i, b in enumerate(bits)]
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            rows.append((path, n, count, bits, error))
        yield pd.DataFrame(rows, columns=["path", "n", "count", "bits", "error"])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, path, begin, end, names, led, first, bits in batch.itertuples(index=False, name=None):
            dtype = {led + i: d for i, b in enumerate(bits) if (d := dtype_of(b))}
            for frame in _frames(path, begin, end, names, led, dtype):
                texts = [" | ".join(str(v) for v in row if pd.notna(v)) for row in frame.itertuples(index=False, name=None)]
                if texts:
                    yield pd.DataFrame({"filename": name, "part": range(first, first + len(texts)), "content": texts, "error": None})
                first += len(texts)


def csv_rows(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(filename, part, content, error): each row of the CSV files whose ranges file_ranges() gave, numbered in its file from 0.

    Values are typed as pandas types whole columns, joined by " | ", and nulls
    left out; blank lines are no rows. A file that isn't sound CSV in UTF-8 is
    one row with its error. Integers past 64 bits among fractions stay text. No
    files, or files with a header alone: no rows.
    """
    records = kept(_records(files.mapInPandas(_scanned, SCANNED)))
    heads = kept(records.where("begin = 0").select("path", "sample_end").mapInPandas(_headed, "path string, names array<string>, led int, head_error string"))
    tasks = max(1, min(records.count(), MOST_TASKS))
    ranges = records.join(heads, "path")

    def spread(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks)  # much work in few bytes

    to_type = spread(ranges.where("head_error IS NULL").select("path", "n", "begin", "end", "names", "led"))
    typed = kept(to_type.mapInPandas(_typed, "path string, n int, count long, bits array<int>, error string"))
    columns = typed.select("path", F.posexplode("bits").alias("i", "bits")).groupBy("path", "i").agg(F.bit_or("bits").alias("bits"))
    kinds = columns.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "bits"))), lambda c: c["bits"]).alias("bits"))
    errors = heads.select("path", "head_error").join(typed.groupBy("path").agg(F.min("error").alias("error")), "path", "left")
    told = errors.select("path", F.coalesce("head_error", "error").alias("error"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first = typed.select("path", "n", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    sound = ranges.join(told.where("error IS NULL").select("path"), "path").join(first, ["path", "n"]).join(kinds, "path")
    made = spread(sound.select("filename", "path", "begin", "end", "names", "led", "first", "bits")).mapInPandas(_rows, SCHEMA)
    bad = records.where("begin = 0").join(told.where("error IS NOT NULL"), "path")
    return made.unionByName(bad.select("filename", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("content"), "error"))
