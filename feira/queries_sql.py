"""Queries through spark.sql, over the functions that SQL can call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions import sql
from .queries import query
from .sources import bind
from .sql import lcs_sql, token_set_sql


def _session(s: SparkSession, d: str) -> SparkSession:
    bind.with_as_of(bind.prices(s, d), s, d).createOrReplaceTempView("prices")
    bind.stores(s, d).createOrReplaceTempView("stores")
    bind.read_table(s, d, "part").createOrReplaceTempView("part")
    sql.register(s)
    return s


@query("""SELECT id, strip_accents('ação ' || name) AS plain, regexp_replace(upper(name || ' é'), '[^A-Z0-9 ]', '', 'g') AS normalized, CASE tier WHEN 1 THEN 10080 WHEN 4 THEN 43200 ELSE 1440 END AS minutes FROM stores""")
def sql_text_functions(s, d) -> DataFrame:
    return _session(s, d).sql("SELECT id, deaccent(concat('ação ', name)) AS plain, normalize_store_name(concat(name, ' é')) AS normalized, default_scrape_frequency_minutes(CAST(tier AS INT)) AS minutes FROM stores")


@query("""SELECT id, round(round(raw_price / CASE tier WHEN 1 THEN 12 * (total_kg / 1000) WHEN 2 THEN total_kg + 0.5 WHEN 3 THEN 6 * (total_kg / 1000) END, 4)::DECIMAL(24, 4), 2)::DOUBLE AS price_per_kg FROM prices""")
def sql_normalize_price(s, d) -> DataFrame:
    return _session(s, d).sql("""WITH n AS (SELECT id, normalize_price(CAST(raw_price AS DOUBLE), CASE tier WHEN 1 THEN concat('cx 12x', CAST(total_kg AS INT), 'g') WHEN 2 THEN concat(CAST(total_kg AS INT), ',5kg')
      WHEN 3 THEN concat('6un ', CAST(total_kg AS INT), 'ml') ELSE 'un' END) AS n FROM prices) SELECT id, n.price_per_kg FROM n""")


@query(", pairs AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part) " + token_set_sql("pairs") + f"SELECT a, b, round(200.0::DOUBLE * {lcs_sql('upper(a)', 'upper(b)')} / (length(a) + length(b)), 6) AS ratio, round(token_set, 6) AS token_set FROM scored")
def sql_similarities(s, d) -> DataFrame:
    return _session(s, d).sql("SELECT a, b, round(fuzz_ratio(upper(a), upper(b)), 6) AS ratio, round(token_set_ratio(a, b), 6) AS token_set FROM (SELECT DISTINCT p_name AS a, p_type AS b FROM part)")


@query("""SELECT p.id, round((price_per_kg - mean) / std, 6) AS zscore FROM (SELECT *, avg(price_per_kg) OVER (PARTITION BY ingredient_id) AS mean, stddev_samp(price_per_kg) OVER (PARTITION BY ingredient_id) AS std
FROM prices WHERE price_per_kg > 0 AND collected_at::DATE >= as_of - 365) p WHERE std > 0 AND abs((price_per_kg - mean) / std) > 1.5::DOUBLE""")
def sql_price_outliers(s, d) -> DataFrame:
    last = bind.read_table(s, d, "lineitem").agg({"l_shipdate": "max"}).first()[0]
    return _session(s, d).sql(f"SELECT id, round(zscore, 6) AS zscore FROM detect_price_outliers(DATE'{last:%Y-%m-%d}', 365, 1.5D)")


@query(""", n AS (SELECT id, is_active, regexp_replace(upper(name), '[^A-Z0-9 ]', '', 'g') AS n FROM stores)
SELECT a.id AS asked, b.id::VARCHAR AS id, round(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)), 6) AS similarity FROM n a JOIN n b ON b.is_active WHERE 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) >= 0.95::DOUBLE""")
def sql_similar_store(s, d) -> DataFrame:
    return _session(s, d).sql("SELECT a.id AS asked, f.id, round(f.similarity, 6) AS similarity FROM stores a, LATERAL find_similar_store(lower(a.name), 0.95D) f")
