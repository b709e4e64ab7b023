"""Streams give what their batch twins give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from feira.operators import maintain as M
from feira.operators import monitor as O
from feira.plans import price_store
from feira.sources import files, versions
from feira.streaming import jobs


def test_stream_upsert(spark, tmp_path):
    row = lambda k, i, p, d: (k, i, "1", "S", "x", "1kg", p, p, dt.datetime(2026, 3, d), None, None, False, 1, 1.0, None)
    batches = [[row("1", "a", 10.0, 1), row("2", "b", 5.0, 1)], [row("3", "a", 8.0, 1), row("4", "a", 7.0, 2), row("5", None, 7.0, 2)]]
    src, root, ck = (str(tmp_path / x) for x in ("src", "table", "ck"))
    for b in batches:
        spark.createDataFrame(b, files.PRICE_ROW).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_upsert_prices(spark, src, files.PRICE_ROW, root, ck)
    twin = spark.createDataFrame(batches[0], files.PRICE_ROW)
    twin = M.upsert_prices(twin, spark.createDataFrame(batches[1], files.PRICE_ROW))[0]
    want = sorted((r["ingredient_id"], r["price_per_kg"]) for r in twin.collect())
    for t in price_store.TABLES:
        got = sorted((r["ingredient_id"], r["price_per_kg"]) for r in versions.read(spark, root, t).collect())
        assert got == want == [("a", 7.0), ("a", 8.0), ("b", 5.0)]
    # the same batch again, as after a failure
    n = versions.version(spark, root).number
    assert price_store.store_prices(spark, root, spark.createDataFrame(batches[0], files.PRICE_ROW), ("stream_upsert_prices", 1)) == n == 2


RUN = "id long, store_name string, status string, reason string, started_at timestamp"


def streaks(spark, source, root, at, **kw):
    jobs.run_to_table(jobs.stream_failure_streak(spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).parquet(source), **kw), root, "streaks", at)
    return {r["store_name"]: (r["streak"], r["disabled"]) for r in versions.read(spark, root, "streaks").collect()}


def test_stream_failure_streak_out_of_order_and_restarted(spark, tmp_path):
    r = random.Random(2)
    source, root, at = (str(tmp_path / x) for x in ("in", "out", "ck"))
    begin = dt.datetime(2026, 3, 1)
    rows = [(k, r.choice("abc"), r.choice(["error", "failed", "error", "completed"] if k % 5 else ["error"]), r.choice(["404", "timeout", "captcha"]), begin + dt.timedelta(hours=k // 2)) for k in range(160)]
    rows.sort(key=lambda x: (x[4] + dt.timedelta(hours=r.randrange(30)), x[0]))  # up to 30 hours late
    seen = []
    for k in range(0, 160, 54):  # each part by a job of its own, from the checkpoint
        seen += rows[k:k + 54]
        for half in (rows[k:k + 27], rows[k + 27:k + 54]):
            if half:
                spark.createDataFrame(half, RUN).coalesce(1).write.mode("append").parquet(source)
        got = streaks(spark, source, root, at, late="40 hours", forget=300)
        twin = O.permanent_streak(spark.createDataFrame(seen, RUN))
        assert got == {x["store_name"]: (x["streak"], x["streak"] >= 3) for x in twin.collect()}


def test_stream_failure_streak_late_and_forgotten(spark, tmp_path):
    source, root, at = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def put(*rows):
        spark.createDataFrame([(k, s, st, "404", dt.datetime(2026, m, d)) for k, s, st, m, d in rows], RUN).coalesce(1).write.mode("append").parquet(source)
        return streaks(spark, source, root, at, late="2 days", forget=40)

    assert put((1, "a", "error", 3, 1), (2, "a", "error", 3, 2), (3, "b", "error", 3, 1)) == {"a": (2, False), "b": (1, False)}
    assert put((4, "a", "error", 3, 20)) == {"a": (3, True), "b": (1, False)}
    # a success of long ago is late and dropped; the failures before the watermark are settled
    assert put((5, "a", "completed", 3, 1), (6, "a", "error", 3, 21))["a"] == (4, True)
    assert put((7, "a", "completed", 3, 22))["a"] == (0, False)
    # b had no run for over 40 days, so its streak begins again
    put((8, "a", "error", 5, 30))
    assert put((9, "b", "error", 5, 31), (10, "a", "error", 5, 31)) == {"a": (2, False), "b": (1, False)}


def test_stream_queue(spark, tmp_path):
    schema = "id long, status string"
    spark.createDataFrame([(1, "pending"), (2, "done")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_queue(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "processed")]


def test_imports(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ingredient,store,price,unit,collected_at,brand\nLeite,Loja Manual,\"5,50\",1kg,2026-03-01,X\nNada,Loja Manual,5,1kg,2026-03-01,X\nLeite,Loja Manual,abc,1kg,2026-03-01,X\n")
    ing = spark.createDataFrame([("Leite",)], "canonical_name string")
    st = spark.createDataFrame([("1", "Loja Manual")], "id string, name string")
    good, bad = files.import_manual_prices(spark, str(tmp_path / "m.csv"), ing, st)
    assert [(r["raw_price"], r["tier"], r["normalized"]["price_per_kg"]) for r in good.collect()] == [(5.5, 4, 5.5)]
    assert sorted(r["error"] for r in bad.collect()) == ["bad price", "unknown ingredient"]
    g = files.generate_prices(spark, 5, 10, 30)
    assert 0 < g.count() < 1500 and g.filter("price_per_kg <= 0").count() == 0
    assert g.agg(F.countDistinct("ingredient_id")).first()[0] <= 5
