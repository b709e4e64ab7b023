"""Price analytics: counts, coverage, trends, winners, rankings, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ppk() -> Column:
    return F.when(F.col("price_per_kg") > 0, F.col("price_per_kg"))


def kpis(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count("*").alias("total_prices"), F.countDistinct("ingredient_id").alias("ingredients"),
                      F.countDistinct("store_id").alias("stores"), F.round(F.avg(_ppk()), 4).alias("avg_ppk"))


def coverage_by_ingredient(prices: DataFrame) -> DataFrame:
    """Stores, prices, least and mean positive price per kg (0 when none) by ingredient."""
    return prices.groupBy("ingredient_id").agg(
        F.countDistinct("store_id").alias("store_count"), F.count("*").alias("price_count"),
        F.coalesce(F.min(_ppk()), F.lit(0.0)).alias("min_ppk"), F.round(F.coalesce(F.avg(_ppk()), F.lit(0.0)), 4).alias("avg_ppk"))


def price_trends(prices: DataFrame, ingredient: str) -> DataFrame:
    """Daily mean, least and largest price per kg; store_count is the number of rows
    (as named in the source system), distinct_stores that of stores."""
    p = prices.filter((F.col("ingredient_id") == ingredient) & (F.col("price_per_kg") > 0))
    return p.groupBy(F.to_date("collected_at").alias("day")).agg(
        F.round(F.avg("price_per_kg") + 1e-7, 2).alias("avg_ppk"), F.min("price_per_kg").alias("min_ppk"), F.max("price_per_kg").alias("max_ppk"),
        F.count("*").alias("store_count"), F.countDistinct("store_id").alias("distinct_stores"))


def history_stats(prices: DataFrame) -> DataFrame:
    """Mean, least, largest, sample deviation and count of positive prices by store."""
    p = prices.filter("price_per_kg > 0")
    return p.groupBy("store_id").agg(*[F.round(f("price_per_kg"), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp))],
                                     F.min("price_per_kg").alias("min"), F.max("price_per_kg").alias("max"),
                                     F.count("*").alias("n"))


def best_price_per_ingredient(prices: DataFrame) -> DataFrame:
    """Cheapest row (no price counts as 999999; ties by id) and distinct stores."""
    p = prices.withColumn("ppk", F.coalesce(_ppk(), F.lit(999999.0)))
    return p.groupBy("ingredient_id").agg(
        F.min_by(F.struct("id", "store_id", "ppk"), F.struct("ppk", "id")).alias("r"), F.countDistinct("store_id").alias("stores")).select(
        "ingredient_id", "r.id", "r.store_id", F.col("r.ppk").alias("ppk"), "stores")


def best_price_per_store(prices: DataFrame, keep: int | None = None) -> DataFrame:
    """Each (ingredient, store)'s cheapest row with the ingredient's offers and
    stores; with keep, only the cheapest stores of each ingredient."""
    p = prices.filter("price_per_kg > 0")
    best = p.groupBy("ingredient_id", "store_id").agg(F.min_by(F.struct("id", "price_per_kg"), F.struct("price_per_kg", "id")).alias("r"), F.count("*").alias("n"))
    w = Window.partitionBy("ingredient_id")
    out = best.select("ingredient_id", "store_id", "r.id", "r.price_per_kg", F.sum("n").over(w).alias("offers"), F.count("*").over(w).alias("stores"))
    if keep is not None:
        out = out.withColumn("rank", F.row_number().over(w.orderBy("price_per_kg", "id"))).filter(F.col("rank") <= keep)
    return out


def longitudinal_winners(prices: DataFrame) -> DataFrame:
    """Days on which a store was the cheapest for an ingredient (ties to the smaller
    store id). Two partial aggregates."""
    p = prices.filter("price_per_kg > 0")
    daily = p.groupBy("ingredient_id", F.to_date("collected_at").alias("day")).agg(F.min_by("store_id", F.struct("price_per_kg", "store_id")).alias("store_id"))
    return daily.groupBy("ingredient_id", "store_id").agg(F.count("*").alias("wins"))


def cross_ingredient_ranking(prices: DataFrame) -> DataFrame:
    """Per store: ingredients priced, and those in which its best row is first or in
    the first three of all rows (rows, not stores, take places).

    Only an ingredient's three cheapest rows can hold a place, so they are the only
    ones ranked; totals are a count of distinct pairs.
    """
    p = prices.filter("price_per_kg > 0")
    w = Window.partitionBy("ingredient_id").orderBy("price_per_kg", "id")
    top = p.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").groupBy("ingredient_id", "store_id").agg(F.min("rank").alias("rank"))
    places = top.groupBy("store_id").agg(F.count_if(F.col("rank") == 1).alias("top1_count"), F.count("*").alias("top3_count"))
    total = p.groupBy("store_id").agg(F.countDistinct("ingredient_id").alias("total_ingredients"))
    return total.join(places, "store_id", "left").na.fill(0, ["top1_count", "top3_count"])


def top_n_per_ingredient(prices: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("ingredient_id").orderBy("price_per_kg", "id")
    return prices.filter("price_per_kg > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def last_n_average(prices: DataFrame, n: int = 30) -> DataFrame:
    """Mean of the newest n rows of each ingredient."""
    w = Window.partitionBy("ingredient_id").orderBy(F.desc("collected_at"), "id")
    p = prices.filter("price_per_kg > 0").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    return p.groupBy("ingredient_id").agg(F.round(F.avg("price_per_kg"), 4).alias("avg_ppk"), F.count("*").alias("n"))


def cheapest_offers(prices: DataFrame, n: int = 10) -> DataFrame:
    return prices.filter("price_per_kg > 0").orderBy("price_per_kg", "id").limit(n)


def top_average_ingredients(prices: DataFrame, n: int = 20) -> DataFrame:
    p = prices.filter("price_per_kg > 0").groupBy("ingredient_id").agg(F.round(F.avg("price_per_kg"), 4).alias("avg_ppk"), F.countDistinct("store_id").alias("stores"))
    return p.orderBy(F.desc("avg_ppk"), "ingredient_id").limit(n)


def price_distribution(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ingredient_id").agg(F.count("*").alias("n"))


def status_summary(prices: DataFrame) -> DataFrame:
    return prices.agg(F.max("collected_at").alias("last_collected"), F.count("*").alias("total"), F.countDistinct("store_id").alias("stores"),
                      F.count_if(F.col("confidence") >= 0.95).alias("confident"))


def snapshot_summary(prices: DataFrame) -> DataFrame:
    return prices.agg(F.max("collected_at").alias("collected_at"), F.count("*").alias("total_prices"), F.countDistinct("ingredient_id").alias("ingredients_found"))


def store_coverage(stores: DataFrame, prices: DataFrame, as_of: Column, stale_days: int = 3) -> DataFrame:
    """Active stores with their newest price date, its age, distinct ingredients and
    prices; stale beyond stale_days or without a price."""
    p = prices.groupBy("store_id").agg(F.max("valid_from").alias("last_price_date"), F.countDistinct("ingredient_id").alias("ingredients_covered"), F.count("*").alias("total_prices"))
    age = F.datediff(as_of, "last_price_date")
    out = stores.filter("is_active").join(p, F.col("id") == F.col("store_id"), "left")
    return out.select(F.col("id").alias("store_id"), "name", "tier", "last_price_date", age.alias("days_since_price"),
                      F.coalesce("ingredients_covered", F.lit(0)).alias("ingredients_covered"), F.coalesce("total_prices", F.lit(0)).alias("total_prices"),
                      F.coalesce(age > stale_days, F.lit(True)).alias("is_stale"))


def coverage_order(coverage: DataFrame) -> DataFrame:
    """Fresh before stale, a known age before none, the older first."""
    return coverage.orderBy("is_stale", F.col("days_since_price").isNull(), F.desc("days_since_price"), "store_id")


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count("*").alias("total_stores"), F.count_if(~F.col("is_stale")).alias("fresh"), F.count_if("is_stale").alias("stale"),
                        F.count_if(F.col("total_prices") == 0).alias("no_price"),
                        F.coalesce(F.round(100.0 * F.count_if(~F.col("is_stale")) / F.count("*"), 1), F.lit(0.0)).alias("coverage_pct"))
