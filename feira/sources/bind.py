"""The driver's tables as the tables of the domain, with projections that Spark
pushes into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations: a line item is an observation of a part at a supplier."""
    t = lambda n: read_table(spark, sf_dir, n)
    day = F.to_date("l_shipdate")
    return (t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("p_name").alias("ingredient_id"),
                    F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"),
                    F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("raw_product"), F.col("l_extendedprice").alias("raw_price"),
                    F.col("l_quantity").alias("total_kg"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_kg"),
                    F.col("l_shipdate").alias("collected_at"), day.alias("valid_from"), F.date_add(day, 7).alias("valid_until"),
                    (F.col("l_discount") >= 0.08).alias("is_promotion"), (F.lit(1) + F.col("s_nationkey") % 4).alias("tier"),
                    (F.lit(1) - F.col("l_tax")).alias("confidence"), F.col("p_brand").alias("brand")))


def with_as_of(df: DataFrame, spark: SparkSession, sf_dir: str, back: int = 0) -> DataFrame:
    """The reference date (the last ship date, less so many days) as a column: one
    row that is joined by broadcast."""
    day = read_table(spark, sf_dir, "lineitem").agg(F.date_sub(F.max(F.to_date("l_shipdate")), back).alias("as_of"))
    return df.crossJoin(F.broadcast(day))  # one row


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"),
        (F.lit(1) + F.col("s_nationkey") % 4).alias("tier"), (F.col("s_acctbal") >= 0).alias("is_active"))


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("canonical_name")).agg(
        F.min("p_type").alias("category"), F.array_sort(F.collect_set("p_brand")).alias("brands"))


def scraping_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("store_name"),
        F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("items_found"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted quantities: an order is a basket of parts."""
    l, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return (l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("basket_id"), F.col("p_name").alias("ingredient_id"))
            .agg(F.sum("l_quantity").alias("qty_kg")))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw_product"), F.col("source").alias("store_name"),
        (0.5 + 0.4 * F.coalesce("quality", F.lit(0))).alias("confidence"), F.lit("pending").alias("status"), F.lit("manual").alias("match_type"))
