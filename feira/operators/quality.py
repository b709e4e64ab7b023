"""Data quality: schema, integrity and key checks as result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schema_check(df: DataFrame, table: str, manifest: dict[str, str]) -> DataFrame:
    """A row for each column of the manifest: ok, missing or type."""
    have = dict(df.dtypes)
    rows = [(table, c, t, have.get(c), "missing" if c not in have else "ok" if have[c] == t else "type") for c, t in manifest.items()]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, expected string, found string, result string")


def orphan_prices(prices: DataFrame, stores: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Prices whose store or ingredient is missing, by (kind, key): rows."""
    s = prices.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_anti").groupBy(F.col("store_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    i = prices.join(ingredients.select(F.col("canonical_name").alias("ingredient_id")), "ingredient_id", "left_anti").groupBy(F.col("ingredient_id").alias("key")).agg(F.count("*").alias("n"))
    return s.withColumn("kind", F.lit("store")).unionByName(i.withColumn("kind", F.lit("ingredient")))


def integrity_report(prices: DataFrame, stores: DataFrame, ingredients: DataFrame, logs: DataFrame, queue: DataFrame, flyers: DataFrame | None = None) -> DataFrame:
    """One row per check: orphan stores and ingredients of prices, logs of unknown
    stores, approved reviews without an ingredient, flyers without an image."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).withColumn("check", F.lit(name))

    names = stores.select(F.col("name").alias("store_name"))
    out = (count(prices.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_anti"), "orphan_store")
           .unionByName(count(prices.join(ingredients.select(F.col("canonical_name").alias("ingredient_id")), "ingredient_id", "left_anti"), "orphan_ingredient"))
           .unionByName(count(logs.withColumn("store_name", F.col("store_name").cast("string")).join(names, "store_name", "left_anti"), "unknown_log_store"))
           .unionByName(count(queue.filter("status = 'approved' and resolved_ingredient is null") if "resolved_ingredient" in queue.columns else queue.filter("status = 'approved'"), "approved_without_ingredient")))
    return out if flyers is None else out.unionByName(count(flyers.filter("image_url is null"), "flyer_without_image"))


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
