"""Prices with what is derived from them, kept up to date in the same commit.

Beside prices and history the store of plans/price_store.py then holds

* moments: count, mean, sum of squared deviations, least and largest positive price
  of each (ingredient, store, day) of the history. A batch recomputes the days it
  touches; statistics merge the days of their window (Chan et al.'s sums, so no large
  squares are subtracted).
* open: prices whose validity has not ended, cut by the day it ends: the index by which
  validity expires, as whole days leave the list.
* latest: the newest valid row of each (ingredient, store), cut in the same way. Only
  keys with a new, changed or removed price, with a row that ran out, or with one that
  began to hold are recomputed, from `open` alone.

A change reads the touched periods of the history, and the keys of `open` and `latest`.
Days only go forward: `as_of` of a change is that of the one before, or later.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintain, prices
from ..sources import versions
from ..sources.versions import Change, Version
from ..sources.work import work_path
from .price_store import KEYS, TABLES

OFFER = ["ingredient_id", "store_id"]
DAY = [*OFFER, "day"]
OPEN = [*KEYS, "valid_until"]
LATEST = [*OFFER, "valid_until"]


def moments(history: DataFrame) -> DataFrame:
    """Moments of the positive prices of each (ingredient, store, day)."""
    p = history.filter("price_per_kg > 0").withColumn("day", F.to_date("collected_at"))
    x = F.col("price_per_kg")
    return p.groupBy(*DAY).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count("*")).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"))


def merged_stats(days: DataFrame, as_of: dt.date, window: int = 90, by_store: bool = True) -> DataFrame:
    """historical_stats from moments of days: the same rows and columns. Deviations are
    taken from the merged mean, which is joined back: moments, not prices, move."""
    keys = OFFER if by_store else OFFER[:1]
    d = days.filter((F.col("n") > 0) & (F.col("day") >= F.lit(as_of - dt.timedelta(window))))
    whole = d.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2)
    g = d.join(whole, keys).groupBy(*keys).agg(F.first("all_mean").alias("mean"), F.sqrt(spread / F.sum("n")).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("n"))
    enough = F.col("n") >= 3
    return g.select(*keys, *[F.when(enough, F.col(c)).otherwise(0.0).alias(c) for c in ("mean", "std", "min", "max")], F.when(enough, F.col("n")).otherwise(0).alias("n"))


def stats(spark: SparkSession, root: str, as_of: dt.date, window: int = 90, by_store: bool = True) -> DataFrame:
    """historical_stats of the stored history; reads the window's periods of moments."""
    return merged_stats(versions.read(spark, root, "moments", since=as_of - dt.timedelta(window)), as_of, window, by_store)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """latest_prices of the stored prices, at the day of the last change."""
    return versions.read(spark, root, "latest")


def store(spark: SparkSession, root: str, incoming: DataFrame, as_of: dt.date, batch: tuple[str, int] | None = None, unit: str = "day", ends: str = "day") -> int:
    """A batch into prices and history, with moments and latest prices as of a day, in
    one commit. A batch that is repeated changes nothing. An empty batch moves the day.
    unit, ends: periods that new tables are cut by, of collection and of validity's end."""
    if batch and versions.version(spark, root).batches.get(batch[0], -1) >= batch[1]:
        return versions.version(spark, root).number
    path = work_path(spark, "batch")
    maintain.priced(incoming).write.parquet(path)  # read for each of the tables
    rows = spark.read.schema(incoming.schema).parquet(path).select(*incoming.columns)
    return _change(spark, root, as_of, {t: Change(rows, keys=KEYS, unit=unit) for t in TABLES}, rows, rows.select(*KEYS).filter("false"), batch, ends)


def delete_where(spark: SparkSession, root: str, gone: Column, as_of: dt.date) -> int:
    """The rows of both tables that fit a condition go, and leave moments and latest
    prices, in one commit."""
    out = {t: Change(gone=versions.read(spark, root, t).filter(gone)) for t in TABLES}
    path = work_path(spark, "gone")
    reduce(DataFrame.union, [c.gone.select(*KEYS) for c in out.values()]).distinct().write.parquet(path)
    lost = spark.read.parquet(path)
    return _change(spark, root, as_of, out, versions.read(spark, root, "prices").filter("false"), lost)


def retain(spark: SparkSession, root: str, as_of: dt.date) -> int:
    """Rows older than each table keeps them go, with their moments and latest prices."""
    edge = {t: as_of - dt.timedelta(maintain.RETENTION[t]) for t in TABLES}
    out = {t: Change(until=d) for t, d in edge.items()} | {"moments": Change(until=edge["price_history"])}
    old = versions.read(spark, root, "open").filter(F.to_date("collected_at") < F.lit(edge["prices"])).select(*KEYS)
    return _change(spark, root, as_of, out, None, old)


def _change(spark: SparkSession, root: str, as_of: dt.date, changes: dict[str, Change], rows: DataFrame | None, lost: DataFrame, batch: tuple[str, int] | None = None, ends: str = "day") -> int:
    """Commit the changes with those of the derived tables. rows: put into both tables
    (None: nothing that moments need); lost: keys of rows that go."""
    v = versions.version(spark, root)
    before = _day(spark, root, v)
    if before and as_of < before:
        raise ValueError(f"the latest prices are of {before}, later than {as_of}")
    moved = lost if rows is None else lost.unionByName(rows.select(*KEYS))
    if rows is not None:
        changes["moments"] = Change(_moments(spark, root, v, rows, lost, moved), keys=tuple(DAY), date="day", unit=changes["prices"].unit)
    columns = _like(spark, root, v, rows)
    had = versions.read(spark, root, "open") if "open" in v.tables else columns
    shown = versions.read(spark, root, "latest") if "latest" in v.tables else columns
    fresh = (columns if rows is None else rows).filter(F.col("valid_from").isNotNull() & (F.col("valid_until") >= F.lit(as_of)))
    stale = had.join(moved, list(KEYS), "left_semi")
    held = had.filter(F.col("valid_until") >= F.lit(as_of)).join(moved, list(KEYS), "left_anti").unionByName(fresh)
    touched = [moved.select(*OFFER), shown.filter(F.col("valid_until") < F.lit(as_of)).select(*OFFER)]
    if before:
        touched.append(held.filter((F.col("valid_from") > F.lit(before)) & (F.col("valid_from") <= F.lit(as_of))).select(*OFFER))
    keys = reduce(DataFrame.unionByName, touched).distinct()
    new = prices.latest_prices(held.join(keys, OFFER, "left_semi").select(*columns.columns), F.lit(as_of))
    changes["open"] = Change(fresh, gone=stale, until=as_of, keys=tuple(OPEN), date="valid_until", unit=ends)
    changes["latest"] = Change(new, gone=shown.join(keys, OFFER, "left_semi"), until=as_of, keys=tuple(LATEST), date="valid_until", unit=ends)
    changes["latest_day"] = Change(spark.createDataFrame([("as_of", as_of)], "name string, day date"), keys=("name",), date="day", unit="all")
    return versions.commit(spark, root, changes, batch)


def _day(spark: SparkSession, root: str, v: Version) -> dt.date | None:
    return versions.read(spark, root, "latest_day").first()["day"] if "latest_day" in v.tables else None  # one row


def _like(spark: SparkSession, root: str, v: Version, rows: DataFrame | None) -> DataFrame:
    """No rows, with the columns of prices."""
    return (rows if "prices" not in v.tables else versions.read(spark, root, "prices")).filter("false")


def _moments(spark: SparkSession, root: str, v: Version, rows: DataFrame, lost: DataFrame, moved: DataFrame) -> DataFrame:
    """The moments of the days on which a price came, changed or went; n is 0 where
    none is left."""
    days = moved.select(*OFFER, F.to_date("collected_at").alias("day")).distinct()
    now = rows
    if "price_history" in v.tables:
        old = versions.read_beside(spark, root, "price_history", moved).join(moved, list(KEYS), "left_anti")
        now = old.withColumn("day", F.to_date("collected_at")).join(days, DAY, "left_semi").select(*rows.columns).unionByName(rows)
    return days.join(moments(now), DAY, "left").fillna(0, ["n"])
