"""Moments and latest prices kept up to date, against the whole recomputation."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from feira.operators import anomaly as N
from feira.operators import prices as P
from feira.plans import live
from feira.sources import files, versions

START = dt.date(2026, 1, 1)


def price(r, k, day):
    begin = None if r.random() < 0.1 else START + dt.timedelta(day + r.randrange(-1, 4))
    end = None if begin is None or r.random() < 0.05 else begin + dt.timedelta(r.randrange(12))
    ppk = r.choice([None, -1.0, 3.0, 3.0, r.uniform(1, 9)])
    return (k, f"i{r.randrange(4)}", str(r.randrange(3)), "S", "x", "1kg", 5.0, ppk, dt.datetime.combine(START, dt.time()) + dt.timedelta(day), begin, end, False, 1, 1.0, None)


def same(spark, root, day, moments=True):
    got = {tuple(r) for r in live.latest(spark, root).collect()}
    want = {tuple(r) for r in P.latest_prices(versions.read(spark, root, "prices"), F.lit(day)).select(*live.latest(spark, root).columns).collect()}
    assert got == want
    for by_store, keys in ((True, 2), (False, 1)) if moments else ():
        got, want = ({tuple(r[:keys]): r[keys:] for r in x.collect()} for x in (
            live.stats(spark, root, day, 20, by_store), N.historical_stats(versions.read(spark, root, "price_history"), F.lit(day), 20, by_store)))
        assert got.keys() == want.keys()
        for k in got:
            assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9)


def test_batches_with_corrections_and_deletes(spark, tmp_path):
    # every batch has rows of its days and corrects some earlier ones
    r, root, shown = random.Random(5), str(tmp_path / "t"), 0
    for b in range(5):
        rows = [price(r, f"{b}-{k}", 3 * b + r.randrange(3) if k % 3 else r.randrange(3 * b + 3)) for k in range(40)]
        day = START + dt.timedelta(3 * b + 2)
        live.store(spark, root, spark.createDataFrame(rows, files.PRICE_ROW), day, ("b", b), unit="month", ends="month")
        same(spark, root, day, moments=b in (2, 4))
        shown += live.latest(spark, root).count()
    assert shown > 20
    n = live.store(spark, root, spark.createDataFrame(rows, files.PRICE_ROW), day, ("b", 4))
    assert n == versions.version(spark, root).number == 5
    live.delete_where(spark, root, F.col("store_id") == "1", day)
    same(spark, root, day)
    assert versions.read(spark, root, "moments").filter("store_id = '1' and n > 0").count() == 0


def test_days_alone_move_the_view(spark, tmp_path):
    # a price that runs out gives way to an older one, a price ahead begins to hold
    root = str(tmp_path / "t")
    at = lambda d: START + dt.timedelta(d)
    row = lambda k, day, begin, end: (k, "i", "1", "S", "x", "1kg", 5.0, 2.0, dt.datetime.combine(at(day), dt.time()), at(begin), at(end), False, 1, 1.0, None)
    rows = spark.createDataFrame([row("old", 0, 0, 9), row("short", 1, 1, 3), row("ahead", 2, 6, 7)], files.PRICE_ROW)
    seen = []
    live.store(spark, root, rows, at(2))
    for day in (2, 4, 6, 8, 10):
        live.store(spark, root, rows.filter("false"), at(day))
        same(spark, root, at(day), moments=False)
        seen.append([r["id"] for r in live.latest(spark, root).collect()])
    assert seen == [["short"], ["old"], ["ahead"], ["old"], []]
    assert not versions.version(spark, root).tables["open"].days  # ended days are not even listed
    with pytest.raises(ValueError, match="later than"):
        live.store(spark, root, rows, at(1))


def test_retention_reaches_what_is_derived(spark, tmp_path):
    root = str(tmp_path / "t")
    at = lambda d: START + dt.timedelta(d)
    row = lambda k, i, day: (k, i, "1", "S", "x", "1kg", 5.0, 2.0, dt.datetime.combine(at(day), dt.time()), at(day), at(300), False, 1, 1.0, None)
    live.store(spark, root, spark.createDataFrame([row("a", "x", 0), row("b", "y", 0), row("c", "y", 50)], files.PRICE_ROW), at(60))
    live.retain(spark, root, at(120))
    same(spark, root, at(120))
    assert [r["id"] for r in live.latest(spark, root).collect()] == ["c"]
    assert versions.read(spark, root, "moments").count() == 1


def test_empty_store(spark, tmp_path):
    root = str(tmp_path / "t")
    live.store(spark, root, spark.createDataFrame([], files.PRICE_ROW), START)
    same(spark, root, START)
    assert live.latest(spark, root).columns == spark.createDataFrame([], files.PRICE_ROW).columns
