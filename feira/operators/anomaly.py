"""Outliers, anomaly tags, price-drop alerts and isolation scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def historical_stats(prices: DataFrame, as_of: Column, days: int = 90, by_store: bool = True) -> DataFrame:
    """Mean, population deviation, least, largest, n of the last days' positive
    prices; all 0 below 3 observations."""
    p = prices.filter((F.col("price_per_kg") > 0) & (F.to_date("collected_at") >= F.date_sub(as_of, days)))
    keys = ["ingredient_id", "store_id"] if by_store else ["ingredient_id"]
    g = p.groupBy(*keys).agg(F.avg("price_per_kg").alias("mean"), F.stddev_pop("price_per_kg").alias("std"),
                             F.min("price_per_kg").alias("min"), F.max("price_per_kg").alias("max"), F.count("*").alias("n"))
    return g.select(*keys, *[F.when(F.col("n") >= 3, F.col(c)).otherwise(0.0).alias(c) for c in ("mean", "std", "min", "max")],
                    F.when(F.col("n") >= 3, F.col("n")).otherwise(0).alias("n"))


def outlier_join(prices: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Positive prices of the last days with mean, std and zscore of their ingredient.
    Statistics are a partial aggregate joined back, so a hot ingredient is never
    gathered in one window."""
    p = prices.filter((F.col("price_per_kg") > 0) & (F.to_date("collected_at") >= F.date_sub(as_of, days)))
    s = p.groupBy("ingredient_id").agg(F.avg("price_per_kg").alias("mean"), F.stddev_samp("price_per_kg").alias("std")).filter("std > 0")
    return p.join(s, "ingredient_id").withColumn("zscore", (F.col("price_per_kg") - F.col("mean")) / F.col("std"))


def detect_price_outliers(prices: DataFrame, as_of: Column, days: int = 90, threshold: float = 2.0) -> DataFrame:
    """Prices more than threshold sample deviations from their ingredient's mean."""
    return outlier_join(prices, as_of, days).filter(F.abs("zscore") > threshold)


def detect_anomaly(prices: DataFrame, stats: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Each price with tag, severity, is_anomaly, zscore, expected_range and
    historical_mean against its (ingredient, store) history; the deviation is at
    least 0.01. Without three observations: SEM_HISTORICO."""
    p = prices.join(stats.select("ingredient_id", "store_id", "mean", "std", "n"), ["ingredient_id", "store_id"], "left")
    z = (F.col("price_per_kg") - F.col("mean")) / F.greatest(F.col("std"), F.lit(0.01))
    none = F.coalesce(F.col("n") < 3, F.lit(True))
    far = F.abs("zscore") > threshold
    out = p.withColumn("zscore", F.when(~none, z))
    tag = (F.when(none, "SEM_HISTORICO").when(far & (F.col("zscore") < 0), "PRECO_SUSPEITO").when(far, "PRECO_ELEVADO")
           .when(F.col("zscore") < -1, "OFERTA_REAL").otherwise("NORMAL"))
    severity = F.when(none, "none").when(far & (F.abs("zscore") > 3), "high").when(far, "medium").when(F.col("zscore") < -1, "low").otherwise("none")
    span = F.format_string("R$ %.2f ~ R$ %.2f", F.col("mean") - 2 * F.col("std"), F.col("mean") + 2 * F.col("std"))
    told = ~none & (far | (F.col("zscore") < -1))
    return out.withColumns({"tag": tag, "severity": severity, "is_anomaly": F.coalesce(far, F.lit(False)), "expected_range": F.when(told, span),
                            "historical_mean": F.when(told, F.round("mean", 2))}).drop("mean", "std", "n")


def enrich_prices(prices: DataFrame, stats: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Prices with ai_tags and ai_anomaly; rows without a positive price pass through
    with no tags."""
    a = detect_anomaly(prices, stats, threshold)
    ok = F.col("price_per_kg") > 0
    cols = ["is_anomaly", "severity", "tag", "zscore", "expected_range", "historical_mean"]
    return a.withColumns({"ai_tags": F.when(ok, F.array("tag")).otherwise(F.array().cast("array<string>")), "ai_anomaly": F.when(ok, F.struct(*cols))}).drop(*cols)


def enrichment_summary(enriched: DataFrame) -> DataFrame:
    return enriched.agg(F.count("*").alias("total"), F.count_if("ai_anomaly.is_anomaly").alias("anomalies"),
                        F.count_if(F.array_contains("ai_tags", "OFERTA_REAL")).alias("real_offers"))


def price_drop_alerts(prices: DataFrame, n: int = 30, drop: float = 0.10) -> DataFrame:
    """Ingredients whose newest price is at least `drop` below the mean of their last
    n. Newest and mean come from the same n rows."""
    w = Window.partitionBy("ingredient_id").orderBy(F.desc("collected_at"), "id")
    p = prices.filter("price_per_kg > 0").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    g = p.groupBy("ingredient_id").agg(F.max(F.when(F.col("k") == 1, F.col("price_per_kg"))).alias("latest"), F.avg("price_per_kg").alias("mean"))
    fall = (F.col("mean") - F.col("latest")) / F.col("mean")
    return g.withColumn("drop_pct", F.round(100 * fall, 2)).filter(fall >= drop).select(
        "ingredient_id", F.round("latest", 4).alias("latest"), F.round("mean", 4).alias("mean"), "drop_pct")


def alert_fanout(alerts: DataFrame, rules: DataFrame, recipients: DataFrame, trigger: str) -> DataFrame:
    """A row for each alert, enabled rule of the trigger and active recipient on the
    rule's channel; rules and recipients meet on the channel first."""
    r = rules.filter(F.col("enabled") & (F.col("trigger") == trigger)).select(F.col("id").alias("rule_id"), "channel", F.col("trigger").alias("kind"))
    to = recipients.filter("active").select("channel", F.col("id").alias("recipient_id"), "target")
    return alerts.withColumn("kind", F.lit(trigger)).join(r.join(to, "channel"), "kind")


def failure_alerts(logs: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Stores with errors in the last minutes, their number and newest time."""
    e = logs.filter(F.col("status").isin("error", "failed") & (F.col("started_at") >= now - F.expr(f"interval {minutes} minutes")))
    return e.groupBy("store_name").agg(F.count("*").alias("errors"), F.max("started_at").alias("last_error"))


def isolation_score(prices: DataFrame, trees: int = 50, least: int = 10, sample: int = 256, seed: int = 42) -> DataFrame:
    """One-dimensional isolation forest by (ingredient, store) with at least `least`
    prices: id, score in (0, 1), higher is more isolated.

    Trees are grown on at most `sample` values, as the method defines, so what a
    group keeps is bounded: the sample is drawn by a hash of the id, in Spark, and
    prices are scored against it row by row in Arrow batches.
    """
    p = prices.filter("price_per_kg > 0").select("ingredient_id", "store_id", "id", "price_per_kg")
    drawn = p.withColumn("h", F.xxhash64("id", F.lit(seed)))
    w = Window.partitionBy("ingredient_id", "store_id").orderBy("h", "id")
    picked = drawn.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= sample)
    base = picked.groupBy("ingredient_id", "store_id").agg(F.array_sort(F.collect_list("price_per_kg")).alias("base")).filter(F.size("base") >= least)

    def scores(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """All values through all trees at once; a node's cut is a fixed random number
        of (tree, node), so no tree is kept."""
        lo, hi = np.zeros((len(x), trees), np.int64), np.full((len(x), trees), len(v), np.int64)
        level, tree = np.zeros((len(x), trees)), np.arange(trees)[None]
        for _ in range(int(np.ceil(np.log2(max(len(v), 2))))):
            first, last = v[lo], v[hi - 1]
            open_ = (hi - lo > 1) & (last > first)
            if not open_.any():
                break
            h = (((tree * 4099 + lo) * 4099 + hi) * 4099 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            cut = first + (h >> np.uint64(11)).astype(float) / 2.0**53 * (last - first)
            mid = np.searchsorted(v, cut, "right")
            left = x[:, None] <= cut
            lo, hi = np.where(open_ & ~left, np.minimum(mid, hi - 1), lo), np.where(open_ & left, np.maximum(mid, lo + 1), hi)
            level += open_
        mean = (level + expected[hi - lo]).mean(1)
        return 2.0 ** (-mean / max(expected[len(v)], 1e-9))

    expected = np.array([_expected(n) for n in range(sample + 1)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.Series(0.0, index=pdf.index)
            for rows in pdf.groupby(["ingredient_id", "store_id"], sort=False).indices.values():
                out.iloc[rows] = scores(pdf["price_per_kg"].to_numpy()[rows], np.asarray(pdf["base"].iloc[rows[0]]))
            yield pd.DataFrame({"id": pdf["id"], "score": out})

    return p.join(base, ["ingredient_id", "store_id"]).mapInPandas(run, "id string, score double")


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
