"""A managed index: a catalog view over Parquet folders, so that an upsert writes what changed and little else.

The view's text is the index's state. It reads a base, cut into ranges of ids
with a folder each, and some deltas; of an id the row in the newest delta
counts, else the base's. Its properties tell the same state as JSON. An upsert
writes its rows as a new delta and replaces the view, in one statement of the
catalog: before it the old state stands whole, after it the new one, and a run
that broke off leaves no more than folders that nothing names.

A delta is merged with the one before it as long as that isn't at least twice
its size, so there are about as many deltas as their rows have binary digits,
and a row is written again about as often. Once deltas hold a tenth of the base's
rows they are merged into it: ranges that they touch are read and written anew,
the others stay where they are. Folders that neither the new state nor the one
before it names are deleted then.

Reading joins deltas' ids against the base (a broadcast while they are small, as
Spark sees their files' size), so the base isn't shuffled. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete_path, list_paths

#: Rows of a base range about, and the part of the base's rows at which deltas are merged into it.
RANGE_ROWS, MERGE_SHARE = 1 << 20, 0.1
#: Below every id: where the first range begins.
LOWEST = -(1 << 63)
_PROPERTY = "tidemark.state"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.replace("`", "").split("."))


def _root(spark: SparkSession, name: str) -> str:
    """The folder of an index's folders, in its database's."""
    *where, own = name.replace("`", "").split(".")
    found = spark.sql(f"DESCRIBE DATABASE {_quoted('.'.join(where) or spark.catalog.currentDatabase())}").collect()
    return f"{next(r[1] for r in found if r[0] == 'Location').rstrip('/')}/{own}.parts"


def state(spark: SparkSession, name: str) -> dict | None:
    """{"base": [[low, folder, rows], ...], "deltas": [[folder, rows], ...], "schema": [[name, type], ...]} of an index; None if there is none."""
    if not spark.catalog.tableExists(name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()
    told = next((r["value"] for r in rows if r["key"] == _PROPERTY), None)
    if told is None:
        raise ValueError(f"{name} exists and is no managed index")
    return json.loads(told)


def _select(found: dict, id_col: str) -> str:
    """The view's text."""
    columns = ", ".join(f"`{c}`" for c, _ in found["schema"])
    empty = ", ".join(f"CAST(NULL AS {kind}) AS `{c}`" for c, kind in found["schema"])
    read = lambda folder: f"SELECT {columns} FROM parquet.`{folder}`"
    base = " UNION ALL ".join(read(folder) for _, folder, _ in found["base"]) or f"SELECT {empty} WHERE false"
    deltas = [folder for folder, _ in found["deltas"]]
    parts = []
    for i, part in enumerate([f"({base})", *(f"({read(folder)})" for folder in deltas)]):
        newer = " UNION ALL ".join(f"SELECT `{id_col}` FROM parquet.`{folder}`" for folder in deltas[i:])
        parts.append(f"SELECT {columns} FROM {part} p" + (f" LEFT ANTI JOIN ({newer}) n ON p.`{id_col}` = n.`{id_col}`" if newer else ""))
    return " UNION ALL ".join(parts)


def _commit(spark: SparkSession, name: str, found: dict, id_col: str) -> None:
    before = state(spark, name) or found
    told = json.dumps(found).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ('{_PROPERTY}' = '{told}') AS {_select(found, id_col)}")
    if len(found["deltas"]) <= len(before["deltas"]):  # something was merged
        named = {folder.removeprefix(_root(spark, name)).split("/")[1] for of in (before, found) for _, folder, _ in [*of["base"], *((0, *d) for d in of["deltas"])]}
        for path in list_paths(spark, _root(spark, name)):
            if path.rpartition("/")[2] not in named:
                delete_path(spark, path)


def _schema(rows: DataFrame) -> list[list[str]]:
    return [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]


def upsert(spark: SparkSession, name: str, records: DataFrame, id_col: str = "id") -> None:
    """Records written over those of the same id, or as a new index.

    Ids are unique in records and not null, of an integer type; columns are the
    index's. No records: nothing changes, but an index that isn't there is made.
    """
    found = state(spark, name)
    if found is not None and sorted(found["schema"]) != sorted(_schema(records)):
        raise ValueError(f"records' columns differ from those of {name}: {_schema(records)} and {found['schema']}")
    found = found or {"base": [], "deltas": [], "schema": _schema(records)}
    if rows := _write(spark, name, records):
        found["deltas"].append(rows)
    deltas = found["deltas"]
    if sum(n for _, n in deltas) > MERGE_SHARE * sum(n for *_, n in found["base"]):
        _merge(spark, name, found, id_col)
    else:
        some = len(deltas) - 1
        while some > 0 and deltas[some - 1][1] < 2 * sum(n for _, n in deltas[some:]):
            some -= 1
        if some < len(deltas) - 1:
            deltas[some:] = [_write(spark, name, _newest(spark, found, deltas[some:], id_col))]
    _commit(spark, name, found, id_col)


def _write(spark: SparkSession, name: str, rows: DataFrame) -> list | None:
    """[folder, rows] of a new folder of rows; None for none."""
    folder = f"{_root(spark, name)}/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    n = spark.read.schema(rows.schema).parquet(folder).count()  # of the files' footers
    return [folder, n] if n else None


def _newest(spark: SparkSession, found: dict, deltas: list, id_col: str) -> DataFrame:
    """Of each id in some deltas the row in the last of them."""
    columns, rows = [c for c, _ in found["schema"]], None
    for at, (folder, _) in enumerate(deltas):
        part = spark.read.parquet(folder).select(*columns, F.lit(at).alias("_at"))
        rows = part if rows is None else rows.unionByName(part)
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("_at"))))
    return ranked.where("_n = 1").select(*columns)


def _range_of(id_: Column, lows: list[int]) -> Column:
    """The number of the range that an id is in; lows ascend, and ids below the first are in it."""
    return F.size(F.filter(F.lit(lows[1:]).cast("array<long>"), lambda low: low <= id_)) if lows[1:] else F.lit(0)


def _merge(spark: SparkSession, name: str, found: dict, id_col: str) -> None:
    """Deltas into the base, in `found`: the ranges that they touch are written anew, large ones in several."""
    columns, base = [c for c, _ in found["schema"]], found["base"]
    last, lows = _newest(spark, found, found["deltas"], id_col), [low for low, *_ in base] or [LOWEST]
    coming = dict(last.groupBy(_range_of(F.col(id_col), lows).alias("k")).count().collect())  # a row for each range
    merged, n = last, sum(coming.values())
    for k, old in enumerate(base):
        if k in coming:
            kept = spark.read.parquet(old[1]).select(*columns).join(last.select(id_col), id_col, "left_anti")
            merged, n = merged.unionByName(kept), n + old[2]
    pieces = -(-n // RANGE_ROWS)
    bounds = merged.approxQuantile(id_col, [i / pieces for i in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
    starts = sorted({*(lows[k] for k in coming), *map(int, bounds)})  # ranges that aren't touched keep their ends
    folder = f"{_root(spark, name)}/{uuid.uuid4().hex}"
    dealt = merged.withColumn("range", _range_of(F.col(id_col), starts)).repartitionByRange(len(starts), "range")
    dealt.write.partitionBy("range").parquet(folder)
    made = spark.read.parquet(folder).groupBy("range").count().collect()
    fresh = [[starts[r["range"]], f"{folder}/range={r['range']}", r["count"]] for r in made]
    found |= {"base": sorted([part for k, part in enumerate(base) if k not in coming] + fresh), "deltas": []}


def drop(spark: SparkSession, name: str) -> None:
    """The index and all its folders."""
    spark.sql(f"DROP VIEW IF EXISTS {_quoted(name)}")
    delete_path(spark, _root(spark, name))
