"""Tables that change together: immutable Parquet deltas, and a row for each version
that says which of them count.

A commit writes the rows it adds and the keys it takes away (deletion vectors) under
its own version number, for any of the tables, and then appends one row to the table
of versions. Only that row makes the commit; a job that dies before leaves files that
no version names, and the next commit of that number overwrites them. A reader asks
for a version (else the newest) and gets all tables as they were then.

A table is cut by a period of a date column. Whole periods go by leaving the list,
single rows by their keys, which readers take away from deltas of earlier versions;
periods without such keys are read as they are. Compaction rewrites only periods of
many deltas or with keys taken away, vacuum removes files that no kept version names.
One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "version long, batches string, tables string"


@dataclass
class Table:
    """What a version says of a table. days: period -> versions of its deltas; gone:
    period -> versions with keys taken away in it."""

    keys: list[str]
    date: str
    unit: str
    schema: str
    days: dict[str, list[int]] = field(default_factory=dict)
    gone: dict[str, list[int]] = field(default_factory=dict)


@dataclass
class Change:
    """rows: put in the place of those of the same keys; gone: rows of which the keys go;
    until: all rows of earlier dates go (after rows and gone). keys (the date among
    them), date and unit (day, month or year; all: one period) of a new table. dealt: rows
    and keys are written as they lie, with no further shuffle; for few periods, as each task
    writes a file for every period that it has rows of."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    until: dt.date | None = None
    keys: tuple[str, ...] = ()
    date: str = "collected_at"
    unit: str = "day"
    dealt: bool = False


@dataclass
class Version:
    number: int = 0
    batches: dict[str, int] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The newest version, or the stated one; version 0, without tables, if there is none."""
    try:
        found = spark.read.schema(VERSION).parquet(f"{root}/versions")
        found = found.filter(F.col("version") == number) if number is not None else found
        r = found.agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        r = None
    if r is None or r["version"] is None:
        if number:
            raise ValueError(f"there is no version {number}")
        return Version()
    return Version(r["version"], json.loads(r["batches"]), {k: Table(**v) for k, v in json.loads(r["tables"]).items()})


def _period(t: Table) -> Column:
    return (F.lit("all") if t.unit == "all" else F.to_date(F.date_trunc(t.unit, F.col(t.date))).cast("string")).alias("period")


def _with_period(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("period", T.StringType())])


def _write(rows: DataFrame, path: str, dealt: bool = False) -> list[str]:
    """Rows with `period`, written by period; the periods. Spark merges small parts of
    a period and splits large ones, unless the rows are dealt so already."""
    (rows if dealt else rows.hint("rebalance", "period")).write.mode("overwrite").partitionBy("period").parquet(path)
    try:
        return sorted(str(r[0]) for r in rows.sparkSession.read.parquet(path).select("period").distinct().collect())  # a value each folder
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return []  # no rows


def _scan(spark: SparkSession, root: str, kind: str, name: str, schema: T.StructType, live: dict[str, list[int]]) -> DataFrame:
    """The rows of the deltas of the periods, with `at` (version) and `period`. Spark
    prunes the folders that are not live."""
    folders = sorted({v for vs in live.values() for v in vs})
    schema = T.StructType([*schema.fields, T.StructField("at", T.IntegerType()), T.StructField("period", T.StringType())])
    if not folders:
        return spark.createDataFrame([], schema)
    base = f"{root}/{kind}/{name}"
    d = spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/at={v}" for v in folders])
    return d.filter(reduce(lambda a, b: a | b, [(F.col("at") == v) & F.col("period").isin([p for p, vs in live.items() if v in vs]) for v in folders]))


def _rows(spark: SparkSession, root: str, name: str, t: Table, periods: set[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(t.schema))
    keys = T.StructType([f for f in schema.fields if f.name in t.keys])
    live = {p: v for p, v in t.days.items() if periods is None or p in periods}
    cut = {p: v for p, v in t.gone.items() if p in live}
    # keys taken away concern the rows of earlier versions only
    older = {p: [x for x in live[p] if x < max(cut[p])] for p in cut}
    plain = _scan(spark, root, "rows", name, schema, {p: x for p, v in live.items() if (x := [k for k in v if k not in older.get(p, ())])})
    if not any(older.values()):
        return plain.drop("at")
    gone = _scan(spark, root, "gone", name, keys, cut).groupBy(*t.keys).agg(F.max("at").alias("gone_at"))
    rest = _scan(spark, root, "rows", name, schema, {p: v for p, v in older.items() if v}).join(gone, t.keys, "left")
    rest = rest.filter(F.col("gone_at").isNull() | (F.col("at") >= F.col("gone_at"))).select(*plain.columns)
    return plain.unionByName(rest).drop("at")


def read(spark: SparkSession, root: str, name: str, number: int | None = None, since: dt.date | None = None) -> DataFrame:
    """A table as of a version (the newest); only the periods from that of `since` on."""
    t = version(spark, root, number).tables[name]
    first = None if since is None or t.unit == "all" else _edge(since, t.unit)
    return _rows(spark, root, name, t, None if first is None else {p for p in t.days if p >= first}).drop("period")


def read_beside(spark: SparkSession, root: str, name: str, rows: DataFrame, number: int | None = None) -> DataFrame:
    """Only the periods of a table that the dates of `rows` fall in."""
    t = version(spark, root, number).tables[name]
    periods = {r[0] for r in rows.select(_period(t)).distinct().collect()}  # a value each period
    return _rows(spark, root, name, t, periods & set(t.days)).drop("period")


def commit(spark: SparkSession, root: str, changes: dict[str, Change], batch: tuple[str, int] | None = None) -> int:
    """All changes at once, or none; the new version. A batch (of a stream, number)
    that was committed already changes nothing. Keys of the rows must be unique and
    not null."""
    v = version(spark, root)
    if batch and v.batches.get(batch[0], -1) >= batch[1]:
        return v.number
    n = v.number + 1
    written: list[tuple[DataFrame, Table, str]] = []
    for name, c in changes.items():
        t = v.tables.get(name)
        if t is None:
            if c.rows is None:
                raise ValueError(f"there is no table {name}")
            t = v.tables[name] = Table(list(c.keys), c.date, c.unit, c.rows.schema.json())
        schema, lies = T.StructType.fromJson(json.loads(t.schema)), {"dealt": True} if c.dealt else {}
        if c.rows is not None:
            path = f"{root}/rows/{name}/at={n}"
            twin = next((at for rows, x, at in written if rows is c.rows and (x.date, x.unit, x.schema) == (t.date, t.unit, t.schema)), None)
            if twin:  # another table took the same rows: its files are copied, nothing is worked out or moved again
                added = _write(spark.read.schema(_with_period(schema)).parquet(twin), path, dealt=True)
            else:
                added = _write(c.rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("period", _period(t)), path, **lies)
            written.append((c.rows, t, path))
        else:
            added = []
        replaced = set(added) & set(t.days)
        gone = [d.select(*t.keys, _period(t)) for d in (c.gone,) if d is not None]
        if replaced:  # what was just written, by its keys
            gone.append(_scan(spark, root, "rows", name, schema, dict.fromkeys(replaced, [n])).select(*t.keys, "period"))
        for p in added:
            t.days.setdefault(p, []).append(n)
        if c.until is not None:
            edge = _edge(c.until, t.unit)
            t.days = {p: x for p, x in t.days.items() if p >= edge}
            if edge < c.until.isoformat() and edge in t.days:  # the period that the date falls in goes in part
                old = _rows(spark, root, name, Table(**(t.__dict__ | {"days": {edge: [x for x in t.days[edge] if x < n]}})))
                gone.append(old.filter(F.to_date(t.date) < F.lit(c.until)).select(*t.keys, "period"))
        if gone:
            cut = _write(reduce(DataFrame.unionByName, gone).filter(F.col("period").isin(list(t.days))), f"{root}/gone/{name}/at={n}", **lies)
            for p in cut:
                t.gone.setdefault(p, []).append(n)
        t.gone = {p: x for p, x in t.gone.items() if p in t.days}
    if batch:
        v.batches[batch[0]] = batch[1]
    return _publish(spark, root, v, n)


def _edge(day: dt.date, unit: str) -> str:
    return {"day": day, "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[unit].isoformat()


def _publish(spark: SparkSession, root: str, v: Version, n: int) -> int:
    tables = json.dumps({k: t.__dict__ for k, t in v.tables.items()})
    spark.createDataFrame([(n, json.dumps(v.batches), tables)], VERSION).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return n


def compact(spark: SparkSession, root: str, name: str, deltas: int = 4) -> int:
    """Rewrite the periods of more than so many deltas, and those from which keys were
    taken away; others keep their files. The new version (the old one if there is none)."""
    v = version(spark, root)
    t = v.tables[name]
    todo = {p for p, x in t.days.items() if len(x) > deltas or p in t.gone}
    if not todo:
        return v.number
    n = v.number + 1
    kept = set(_write(_rows(spark, root, name, t, todo), f"{root}/rows/{name}/at={n}"))
    t.days = {p: [n] if p in todo else x for p, x in t.days.items() if p not in todo or p in kept}
    t.gone = {}
    return _publish(spark, root, v, n)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove the folders that none of the newest `keep` versions names, and return how
    many; older versions can't be read any more."""
    newest = version(spark, root).number
    named: set[str] = set()
    for r in spark.read.schema(VERSION).parquet(f"{root}/versions").filter(F.col("version") > newest - keep).collect():  # `keep` rows
        for name, t in json.loads(r["tables"]).items():
            named |= {f"{kind}/{name}/at={x}/period={p}" for kind, part in (("rows", "days"), ("gone", "gone")) for p, vs in t[part].items() for x in vs}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = 0
    for kind in ("rows", "gone"):
        for status in fs.globStatus(path(f"{root}/{kind}/*/at=*/period=*")) or []:
            if "/".join(status.getPath().toString().split("/")[-4:]) not in named:
                removed += bool(fs.delete(status.getPath(), True))
    return removed
