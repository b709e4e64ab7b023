"""The price tables as one versioned store: prices and their history change together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain
from ..sources import versions
from ..sources.versions import Change

KEYS = ("ingredient_id", "store_id", "collected_at")
TABLES = ("prices", "price_history")


def store_prices(spark: SparkSession, root: str, incoming: DataFrame, batch: tuple[str, int] | None = None, unit: str = "day") -> int:
    """Take a batch of rows into prices and history, in one commit, as upsert_prices and
    append_history would. A batch that is repeated changes nothing. The rows lie as they
    were made one a key; only by day or month they are dealt again, by period."""
    rows = maintain.priced(incoming)
    return versions.commit(spark, root, {t: Change(rows, keys=KEYS, unit=unit, dealt=unit in ("year", "all")) for t in TABLES}, batch)


def retain(spark: SparkSession, root: str, as_of: dt.date) -> int:
    """Rows older than each table keeps them go: whole periods by leaving the list."""
    return versions.commit(spark, root, {t: Change(until=as_of - dt.timedelta(maintain.RETENTION[t])) for t in TABLES})


def delete_where(spark: SparkSession, root: str, gone: Column) -> int:
    """The rows of both tables that fit a condition go, by their keys, in one commit."""
    return versions.commit(spark, root, {t: Change(gone=versions.read(spark, root, t).filter(gone)) for t in TABLES})


def delete_stores(spark: SparkSession, root: str, stores: DataFrame) -> int:
    """The rows of both tables that depend on removed stores (id) go."""
    out = {}
    for t in TABLES:
        rows = versions.read(spark, root, t)
        kind = dict(rows.dtypes)["store_id"]
        out[t] = Change(gone=rows.join(stores.select(F.col("id").cast(kind).alias("store_id")).distinct(), "store_id", "left_semi"))
    return versions.commit(spark, root, out)
