"""Queries of sources, sinks and streams: the driver's rows are written as files of
the form in question and read back through the operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import monitor as O
from .plans import live, price_store
from .queries import query
from .sources import bind, files, versions
from .sources.work import work_path
from .streaming import jobs


def _sheet(s: SparkSession, d: str, columns: list) -> str:
    """A CSV of the line items with the given columns."""
    t = lambda n: bind.read_table(s, d, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    path = work_path(s, "sheet")
    rows.select(*columns).write.option("header", True).csv(path)
    return path


#: Every eleventh line item names no ingredient, every seventh has no price, every thirteenth no store.
def _cells() -> dict:
    return {"ingredient": F.when(F.col("l_partkey") % 11 == 0, "nothing").otherwise(F.upper("p_name")), "store": F.when(F.col("l_suppkey") % 13 == 0, "nowhere").otherwise(F.col("s_name")),
            "price": F.when(F.col("l_partkey") % 7 == 0, "-").otherwise(F.replace(F.format_string("%.2f", F.col("l_extendedprice").cast("double")), F.lit("."), F.lit(","))),
            "unit": F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("kg"))}


_PPK = "round(round(l_extendedprice / l_quantity, 4)::DECIMAL(24, 4), 2)::DOUBLE"


def _manual(s, d) -> tuple[DataFrame, DataFrame]:
    path = _sheet(s, d, [*(c.alias(k) for k, c in _cells().items()), F.date_format("l_shipdate", "yyyy-MM-dd").alias("collected_at"), F.col("p_brand").alias("brand")])
    return files.import_manual_prices(s, path, bind.ingredients(s, d), bind.stores(s, d))


@query(f"""SELECT p_name AS ingredient_id, s_suppkey AS store_id, l_extendedprice AS raw_price, {_PPK} AS price_per_kg, l_shipdate::DATE AS day, 2 AS tier FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 11 <> 0 AND l_suppkey % 13 <> 0 AND l_partkey % 7 <> 0""")
def import_manual_prices(s, d):
    return _manual(s, d)[0].select("ingredient_id", "store_id", "raw_price", F.col("normalized.price_per_kg").alias("price_per_kg"), F.to_date("collected_at").alias("day"), "tier")


@query("""SELECT error, count(*) AS n FROM (SELECT concat_ws('; ', CASE WHEN l_partkey % 11 = 0 THEN 'unknown ingredient' END, CASE WHEN l_suppkey % 13 = 0 THEN 'unknown store' END,
CASE WHEN l_partkey % 7 = 0 THEN 'bad price' END) AS error FROM lineitem) WHERE error <> '' GROUP BY 1""")
def import_manual_errors(s, d):
    return _manual(s, d)[1].groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT p_name AS ingredient_id, lower(replace(s_name, '#', '_')) AS store_id, l_extendedprice AS raw_price, 2 AS tier, CASE WHEN l_suppkey % 2 = 0 THEN 'Santos' ELSE 'Home' END AS city
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 11 <> 0 AND l_partkey % 7 <> 0 AND l_suppkey % 13 <> 0""")
def import_visit_prices(s, d):
    cells = _cells() | {"store": F.when(F.col("l_suppkey") % 13 == 0, "").otherwise(F.col("s_name"))}
    path = _sheet(s, d, [*(c.alias(k) for k, c in cells.items()), F.when(F.col("l_suppkey") % 2 == 0, "Santos").otherwise("").alias("city")])
    return files.import_visit_prices(s, path, bind.ingredients(s, d), "Home").select("ingredient_id", "store_id", "raw_price", "tier", "city")


@query("SELECT p_name AS canonical_name, min(p_type) AS category, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1")
def load_catalog(s, d):
    path = work_path(s, "catalog")
    bind.ingredients(s, d).select(F.col("canonical_name").alias("canonical"), "category", "brands").write.json(path)
    return files.load_catalog(s, path).select("canonical_name", "category", "brands")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE 'from config' END AS city, n_name || '/' || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0""")
def load_stores(s, d):
    st = bind.stores(s, d).withColumn("config", F.create_map(F.lit("city"), F.lit("from config"), F.lit("url"), F.concat_ws("/", "city", "id")))
    st = st.withColumn("city", F.when(F.col("id") % 3 == 0, F.col("city"))).withColumn("priority", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    return files.load_stores(st, ["city", "url"]).select("id", "city", "url")


@query("SELECT ingredient_id, count(*)::VARCHAR AS n FROM prices GROUP BY 1")
def report_sink(s, d):
    path = work_path(s, "report")
    files.report_sink(bind.prices(s, d).groupBy("ingredient_id").agg(F.count("*").alias("n")), path, "csv")
    return s.read.option("header", True).schema("ingredient_id string, n string").csv(path)


@query("SELECT id, ingredient_id, price_per_kg, tier FROM prices")
def read_table(s, d):
    path = work_path(s, "prices")
    files.report_sink(bind.prices(s, d).withColumns({"store_id": F.col("store_id").cast("string"), "tier": F.col("tier").cast("int")}), path)
    return files.read_table(s, path, files.PRICE_ROW).select("id", "ingredient_id", "price_per_kg", "tier")


# Streams over files of the event table

_RUNS = """, runs AS (SELECT event_id AS id, user_id AS store_name, ts AS started_at, CASE WHEN event_type IN ('error', 'view') THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'read timeout' ELSE 'selector is gone' END AS reason FROM events),
last_ok AS (SELECT store_name, max(struct_pack(a := started_at, b := id)) AS last FROM runs WHERE status = 'completed' GROUP BY 1),
streaks AS (SELECT r.store_name, count(*) FILTER (status = 'error' AND reason LIKE 'selector%' AND (last IS NULL OR struct_pack(a := started_at, b := id) > last)) AS streak
  FROM runs r LEFT JOIN last_ok o ON r.store_name = o.store_name GROUP BY 1) """


def _runs(s, d) -> DataFrame:
    """Runs with reasons: errors and views fail, a third of them for a passing cause."""
    e = bind.read_table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("store_name"), F.col("ts").alias("started_at"), F.when(F.col("event_type").isin("error", "view"), "error").otherwise("completed").alias("status"),
                    F.when(F.col("event_id") % 3 == 0, "read timeout").otherwise("selector is gone").alias("reason"))


@query(_RUNS + "SELECT * FROM streaks")
def permanent_streak(s, d):
    return O.permanent_streak(_runs(s, d))


@query(_RUNS + "SELECT store_name, streak, streak >= 3 AS disabled FROM streaks")
def stream_failure_streak(s, d):
    source, out, at = (work_path(s, n) for n in ("runs", "streaks", "state"))
    runs = _runs(s, d)
    runs.write.parquet(source)
    jobs.run_to_table(jobs.stream_failure_streak(s.readStream.schema(runs.schema).parquet(source), late="3650 days"), out, "streaks", at)
    return versions.read(s, out, "streaks").select("store_name", F.col("streak").cast("long").alias("streak"), "disabled")


# The price tables under versions

_STORED = """, up AS (SELECT *, collected_at::DATE AS day FROM prices WHERE raw_price > 0),
first AS (SELECT arg_min(id, struct_pack(x := price_per_kg, y := id)) AS id, ingredient_id, store_id, day FROM up WHERE NOT is_promotion GROUP BY 2, 3, 4),
second AS (SELECT arg_min(id, struct_pack(x := price_per_kg, y := id)) AS id, ingredient_id, store_id, day FROM up WHERE is_promotion GROUP BY 2, 3, 4),
both_ AS (SELECT * FROM second UNION ALL SELECT * FROM first ANTI JOIN second USING (ingredient_id, store_id, day)) """


def _stored(s, d) -> str:
    """Two batches under versions 1 and 2, the second (promotions) over the first; the
    second comes twice."""
    root = work_path(s, "price-store")
    p = bind.prices(s, d)
    for k, rows in enumerate((p.filter("not is_promotion"), p.filter("is_promotion"), p.filter("is_promotion"))):
        price_store.store_prices(s, root, rows, ("batches", min(k, 1)), unit="year")
    return root


@query(_STORED + "SELECT 'prices' AS name, id FROM both_ UNION ALL SELECT 'history', id FROM both_ UNION ALL SELECT 'before', id FROM first")
def versioned_prices(s, d):
    root = _stored(s, d)
    part = lambda name, *a: versions.read(s, root, *a).select(F.lit(name).alias("name"), "id")
    return part("prices", "prices").unionByName(part("history", "price_history")).unionByName(part("before", "prices", 1))


@query(_STORED + ", last AS (SELECT max(day) AS last FROM up) SELECT id, ingredient_id FROM both_, last WHERE day >= last - 400 - 90 AND store_id NOT IN (SELECT id FROM stores WHERE NOT is_active)")
def versioned_deletes(s, d):
    # stores that are not active go with their prices, then what is older than the table keeps it
    root = _stored(s, d)
    price_store.delete_stores(s, root, bind.stores(s, d).filter("not is_active"))
    last = bind.read_table(s, d, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    price_store.retain(s, root, last - dt.timedelta(400))
    versions.compact(s, root, "prices")
    versions.vacuum(s, root)
    return versions.read(s, root, "prices").select("id", "ingredient_id")


def _live(s, d) -> tuple[str, dt.date]:
    """The prices of 1992 to 1996, then those of the later years, then promotions over
    both, with moments and latest prices kept up to date; prices hold for 60 days."""
    root = work_path(s, "live-prices")
    p = bind.prices(s, d).withColumn("valid_until", F.date_add("valid_from", 60))
    last, early = bind.read_table(s, d, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0], F.col("valid_from") < "1997-01-01"
    for k, (rows, day) in enumerate(((p.filter(~F.col("is_promotion") & early), min(last, dt.date(1996, 12, 31))), (p.filter(~F.col("is_promotion") & ~early), last), (p.filter("is_promotion"), last))):
        live.store(s, root, rows, day, ("batches", k), unit="year", ends="month")
    return root, last


_LIVE = """, one AS (SELECT *, collected_at::DATE AS day FROM prices WHERE raw_price > 0 QUALIFY row_number() OVER (PARTITION BY ingredient_id, store_id, day, is_promotion ORDER BY price_per_kg, id) = 1),
kept AS (SELECT * FROM one WHERE price_per_kg > 0 QUALIFY row_number() OVER (PARTITION BY ingredient_id, store_id, day ORDER BY is_promotion DESC) = 1) """


@query(_LIVE + """SELECT ingredient_id, store_id, id, price_per_kg FROM kept WHERE valid_from <= as_of AND valid_from + 60 >= as_of
QUALIFY row_number() OVER (PARTITION BY ingredient_id, store_id ORDER BY collected_at DESC, id DESC) = 1""")
def maintained_latest_prices(s, d):
    root, _ = _live(s, d)
    return live.latest(s, root).select("ingredient_id", "store_id", "id", "price_per_kg")


@query(_LIVE + """, g AS (SELECT ingredient_id, avg(price_per_kg) AS mean, stddev_pop(price_per_kg) AS std, min(price_per_kg) AS lo, max(price_per_kg) AS hi, count(*) AS n FROM kept
WHERE collected_at::DATE >= as_of - 1000 GROUP BY 1) SELECT ingredient_id, CASE WHEN n >= 3 THEN round(mean, 4) ELSE 0 END AS mean, CASE WHEN n >= 3 THEN round(std, 4) ELSE 0 END AS std,
CASE WHEN n >= 3 THEN lo ELSE 0 END AS min, CASE WHEN n >= 3 THEN hi ELSE 0 END AS max, CASE WHEN n >= 3 THEN n ELSE 0 END AS n FROM g""")
def maintained_stats(s, d):
    root, last = _live(s, d)
    return live.stats(s, root, last, window=1000, by_store=False).select("ingredient_id", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", "n")


@query(_STORED + "SELECT id, ingredient_id FROM both_")
def stream_upsert_prices(s, d):
    source, root, at = (work_path(s, n) for n in ("price-files", "price-stream", "price-state"))
    p = bind.prices(s, d)
    for rows in (p.filter("not is_promotion"), p.filter("is_promotion")):
        rows.write.mode("append").parquet(source)
        jobs.stream_upsert_prices(s, source, p.schema, root, at, unit="year")
    return versions.read(s, root, "prices").select("id", "ingredient_id")


@query("SELECT event_id AS id, 'processed' AS status FROM events WHERE event_type <> 'error'")
def stream_queue(s, d):
    source, out, at = (work_path(s, n) for n in ("queue", "done", "queue-state"))
    q = bind.read_table(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "held").otherwise("pending").alias("status"))
    q.write.parquet(source)
    jobs.stream_queue(s, source, q.schema, out, at)
    return s.read.schema("id long, status string").parquet(out)


@query(""", w AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, user_id AS store_name FROM events WHERE event_type = 'error') SELECT store_name, start, count(*) AS errors FROM w GROUP BY 1, 2""")
def windowed_errors(s, d):
    return jobs.windowed_errors(bind.scraping_logs(s, d)).select("store_name", F.col("window.start").alias("start"), "errors")
