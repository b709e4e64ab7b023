"""Versioned tables: several at once or none, old versions, deletions, compaction."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from feira.operators import maintain as M
from feira.plans import price_store
from feira.sources import files, versions
from feira.sources.versions import Change


def row(k, ingredient, price, day, store="1"):
    return (k, ingredient, store, "S", "x", "1kg", price, price, dt.datetime(2026, 1, 1) + dt.timedelta(day), None, None, False, 1, 1.0, None)


def prices(spark, rows):
    return spark.createDataFrame(rows, files.PRICE_ROW)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("unit", ["day", "month"])
def test_batches_against_upsert(spark, tmp_path, unit):
    r = random.Random(1)
    root, twin = str(tmp_path / "t"), None
    for b in range(4):
        rows = prices(spark, [row(f"{b}-{k}", f"i{r.randrange(6)}", float(r.randrange(1, 50)), 6 * r.randrange(12), str(r.randrange(3))) for k in range(80)])
        assert price_store.store_prices(spark, root, rows, ("b", b), unit) == b + 1
        twin = M.priced(rows) if twin is None else M.upsert_prices(twin, rows)[0]
        twin = spark.createDataFrame(twin.collect(), twin.schema)
        for t in price_store.TABLES:
            assert ids(versions.read(spark, root, t)) == ids(twin)
    old = ids(versions.read(spark, root, "prices", 2))
    since = dt.date(2026, 2, 15)
    some = versions.read(spark, root, "prices", since=since)
    assert set(ids(some)) >= set(ids(twin.filter(F.to_date("collected_at") >= F.lit(since)))) and some.count() < twin.count()
    # deletions of rows and of days
    price_store.delete_where(spark, root, F.col("store_id") == "1")
    price_store.delete_stores(spark, root, spark.createDataFrame([(2,)], "id long"))
    n = price_store.retain(spark, root, dt.date(2026, 2, 5) + dt.timedelta(90))
    want = ids(twin.filter("store_id = '0' and to_date(collected_at) >= date'2026-02-05'"))
    assert ids(versions.read(spark, root, "prices")) == ids(versions.read(spark, root, "price_history")) == want
    assert ids(versions.read(spark, root, "prices", 2)) == old
    assert versions.compact(spark, root, "prices") == n + 1 == versions.version(spark, root).number
    assert ids(versions.read(spark, root, "prices")) == want
    # on disk only what is kept
    assert versions.vacuum(spark, root) > 0
    assert ids(spark.read.option("basePath", f"{root}/rows/prices").parquet(*glob.glob(f"{root}/rows/prices/at=*"))) == want
    assert ids(versions.read(spark, root, "prices")) == want


def test_untouched_days_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "t")
    price_store.store_prices(spark, root, prices(spark, [row(str(k), "a", 1.0, k) for k in range(6)]))
    files_ = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/rows/prices/at=*/period=*/*.parquet")}
    before = files_()
    price_store.delete_where(spark, root, F.col("id") == "3")
    price_store.retain(spark, root, dt.date(2026, 1, 3) + dt.timedelta(90))
    versions.compact(spark, root, "prices")
    versions.vacuum(spark, root)
    after = files_()
    assert ids(versions.read(spark, root, "prices")) == ["2", "4", "5"]
    assert {f for f in after if "01-04" not in f} == {f for f in before if any(d in f for d in ("01-03", "01-05", "01-06"))} and all(before[f] == after[f] for f in after if f in before)


def test_a_commit_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    price_store.store_prices(spark, root, prices(spark, [row("1", "a", 5.0, 0)]), ("b", 0))
    real, calls = versions._write, []

    def dies(rows, path):
        calls.append(path)
        if len(calls) == 2:  # prices are written, their history is not
            raise RuntimeError("lost")
        return real(rows, path)

    monkeypatch.setattr(versions, "_write", dies)
    more = prices(spark, [row("2", "a", 4.0, 0), row("3", "b", 4.0, 1)])
    with pytest.raises(RuntimeError):
        price_store.store_prices(spark, root, more, ("b", 1))
    monkeypatch.setattr(versions, "_write", real)
    for t in price_store.TABLES:
        assert ids(versions.read(spark, root, t)) == ["1"]
    assert price_store.store_prices(spark, root, more, ("b", 1)) == price_store.store_prices(spark, root, more, ("b", 1)) == 2
    for t in price_store.TABLES:
        assert ids(versions.read(spark, root, t)) == ["2", "3"]


def test_edges(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.version(spark, root).number == 0
    with pytest.raises(KeyError):
        versions.read(spark, root, "prices")
    with pytest.raises(ValueError):
        versions.commit(spark, root, {"prices": Change(until=dt.date(2026, 1, 1))})
    price_store.store_prices(spark, root, prices(spark, []))
    assert versions.read(spark, root, "prices").count() == 0 and versions.read(spark, root, "prices").columns == prices(spark, []).columns
    with pytest.raises(ValueError):
        versions.version(spark, root, 9)
    kv = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    versions.commit(spark, root, {"kv": Change(kv(("a", 1), ("b", 2)), keys=("k",), unit="all")})
    versions.commit(spark, root, {"kv": Change(kv(("b", 3), ("c", 4)), gone=kv(("a", 0)))})
    assert sorted(map(tuple, versions.read(spark, root, "kv").collect())) == [("b", 3), ("c", 4)]


def test_twin_tables_work_rows_out_once(spark, tmp_path):
    """Prices and history take the same rows: these are worked out once, and the second
    table's files are as many as the first's."""
    root, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = prices(spark, [row(str(k), f"i{k}", 1.0, 6 * k) for k in range(12)])
    price_store.store_prices(spark, root, rows.mapInPandas(count, rows.schema), ("b", 0), "month")
    assert seen.value == 12
    files_of = lambda t: len(glob.glob(f"{root}/rows/{t}/at=1/period=*/*.parquet"))
    assert files_of("prices") == files_of("price_history") == 3
    assert ids(versions.read(spark, root, "prices")) == ids(versions.read(spark, root, "price_history")) == ids(rows)
    # the newest delta lost nothing: it meets no keys
    price_store.store_prices(spark, root, prices(spark, [row("new", "i1", 2.0, 6)]), ("b", 1), "month")
    for t in price_store.TABLES:
        assert ids(versions.read(spark, root, t)) == sorted([*(str(k) for k in range(12) if k != 1), "new"])
