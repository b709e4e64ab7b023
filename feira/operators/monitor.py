"""Collection logs: health, streaks, due stores, healing, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FAILED = ("error", "failed")


def exclusive_p95(values: Column) -> Column:
    """95th percentile by the exclusive method from 20 values on; the largest below."""
    v, n = F.array_sort(values), F.size(values)
    at = 19 * (n + 1) / 20
    lo = F.greatest(F.lit(1), F.least(F.floor(at).cast("int"), n - 1))
    part = at - lo
    return F.when(n >= 20, F.element_at(v, lo) + part * (F.element_at(v, lo + 1) - F.element_at(v, lo))).when(n > 0, F.element_at(v, F.greatest(n, F.lit(1)))).otherwise(0.0)


def recent_logs(logs: DataFrame, n: int = 200) -> DataFrame:
    return logs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def store_health(logs: DataFrame, window: int = 200) -> DataFrame:
    """Runs, errors, success rate, mean items, p95 latency, last run and items by
    store over the newest `window` logs of all stores (part of the meaning: at most
    so many rows are gathered)."""
    g = recent_logs(logs, window).groupBy("store_name").agg(
        F.count("*").alias("total_runs"), F.count_if(F.col("status").isin(*FAILED)).alias("error_count"), F.sum(F.coalesce("items_found", F.lit(0))).alias("total_items"),
        F.max("started_at").alias("last_run"), F.collect_list("latency_ms").alias("lat"))
    return g.select("store_name", "last_run", ((F.col("total_runs") - F.col("error_count")) / F.col("total_runs")).alias("success_rate"),
                    F.round(exclusive_p95(F.col("lat")), 4).alias("latency_p95_ms"), F.round(F.col("total_items") / F.col("total_runs"), 4).alias("avg_items_per_run"),
                    "total_runs", "error_count", "total_items")


def health_scores(health: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Health rows with health_score, health_label and latency_label. The days since the
    last run are whole ones of 24 hours."""
    h = health.join(failures.select("store_name", F.col("streak").alias("failures_count")), "store_name", "left")
    days = F.floor(F.timestamp_diff("SECOND", F.col("last_run"), now) / 86_400)
    score = T.health_score(F.col("success_rate"), F.col("failures_count"), F.col("avg_items_per_run"), F.col("latency_p95_ms"), days)
    return h.withColumn("health_score", score).withColumn("health_label", T.health_label(F.col("health_score"))).withColumn("latency_label", T.latency_label(F.col("latency_p95_ms")))


def health_buckets(health: DataFrame) -> DataFrame:
    r = F.col("success_rate")
    return health.groupBy(F.when(r >= 0.95, "healthy").when(r >= 0.7, "degraded").otherwise("critical").alias("bucket")).agg(F.count("*").alias("stores"))


def last_runs(logs: DataFrame, n: int = 3) -> DataFrame:
    """The newest n runs of each store, k = 1 the newest."""
    w = Window.partitionBy("store_name").orderBy(F.desc("started_at"), F.desc("id"))
    return logs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def failure_streak(logs: DataFrame, n: int = 3) -> DataFrame:
    """Failures among the newest n runs before the first that did not fail."""
    fail = F.col("status").isin(*FAILED)
    g = last_runs(logs, n).groupBy("store_name").agg(F.min(F.when(~fail, F.col("k"))).alias("first_ok"), F.count("*").alias("runs"))
    return g.select("store_name", F.coalesce(F.col("first_ok") - 1, F.col("runs")).alias("streak"))


def permanent_streak(logs: DataFrame) -> DataFrame:
    """Failures of each store since its last success; transient errors (by reason)
    neither count nor end a streak. The batch twin of stream_failure_streak."""
    fail, at = F.col("status").isin(*FAILED), F.struct("started_at", "id")
    last = logs.filter(~fail).groupBy("store_name").agg(F.max(at).alias("last"))
    counts = fail & ~T.is_transient(T.classify_error(F.col("reason"))) & (F.col("last").isNull() | (at > F.col("last")))
    return logs.join(last, "store_name", "left").groupBy("store_name").agg(F.count_if(counts).alias("streak"))


def auto_disable(logs: DataFrame, n: int = 3) -> DataFrame:
    """Stores whose newest n runs all failed (fewer runs: no)."""
    g = last_runs(logs, n).groupBy("store_name").agg(F.count("*").alias("runs"), F.every(F.col("status").isin(*FAILED)).alias("bad"))
    return g.filter((F.col("runs") == n) & F.col("bad")).select("store_name")


def zero_product_streak(logs: DataFrame, n: int = 3) -> DataFrame:
    """Stores whose newest n runs all completed with no items."""
    g = last_runs(logs, n).groupBy("store_name").agg(F.count("*").alias("runs"), F.every((F.col("status") == "completed") & (F.coalesce("items_found", F.lit(0)) == 0)).alias("bad"))
    return g.filter((F.col("runs") == n) & F.col("bad")).select("store_name")


def last_completed_run(logs: DataFrame) -> DataFrame:
    return logs.filter("status = 'completed'").groupBy("store_name").agg(F.max("started_at").alias("last_completed"))


def last_event(events: DataFrame, event_type: str = "auto_disabled") -> DataFrame:
    return events.filter(F.col("event_type") == event_type).groupBy("scraper_name").agg(F.max_by(F.struct(*events.columns), F.struct("created_at", "id")).alias("e")).select("e.*")


def health_events(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Events of the last days by scraper and type."""
    return events.filter(F.to_date("created_at") >= F.date_sub(as_of, days)).groupBy("scraper_name", "event_type").agg(F.count("*").alias("n"))


def due_stores(stores: DataFrame, logs: DataFrame, now: Column, share: float = 0.8) -> DataFrame:
    """Stores with whether a run is due: minutes since the last completed run are at
    least 0.8 of the frequency (by tier where it has none); never run: due."""
    s = stores.join(last_completed_run(logs), stores["name"] == F.col("store_name"), "left")
    minutes = F.timestamp_diff("MINUTE", F.col("last_completed"), now)
    freq = F.coalesce("frequency_minutes", T.default_frequency(F.col("tier"))) if "frequency_minutes" in stores.columns else T.default_frequency(F.col("tier"))
    return s.select("name", "tier", "last_completed", minutes.alias("minutes"), F.coalesce(minutes >= share * freq, F.lit(True)).alias("is_due"))


def published_today(stores: DataFrame, as_of: Column) -> DataFrame:
    """Flyer stores to read today: their weekday names (an array; Wednesday when
    empty) hold today's, or it is Thursday."""
    day = F.date_format(as_of, "EEEE")
    days = F.when(F.size(F.coalesce("publish_days", F.array().cast("array<string>"))) == 0, F.array(F.lit("Wednesday"))).otherwise(F.col("publish_days"))
    return stores.filter(F.array_contains(F.transform(days, F.lower), F.lower(day)) | (day == "Thursday"))


def verify_run(stores: DataFrame, products: DataFrame, matches: DataFrame) -> DataFrame:
    """Per store of a run: products read and matched; attempted, skipped, matched."""
    p = products.groupBy("store_name").agg(F.count("*").alias("extracted"))
    m = matches.groupBy("store_name").agg(F.count("*").alias("matched"))
    out = stores.select(F.col("name").alias("store_name")).join(p, "store_name", "left").join(m, "store_name", "left").na.fill(0, ["extracted", "matched"])
    return out.withColumn("outcome", F.when(F.col("matched") > 0, "matched").when(F.col("extracted") > 0, "attempted").otherwise("skipped"))


def quota_usage(logs: DataFrame, now: Column, minutes_limit: float = 2000, runs_limit: int = 500) -> DataFrame:
    """Month-to-date minutes, runs of the last day, their shares and warning level."""
    month = F.col("started_at") >= F.date_trunc("month", now)
    g = logs.agg(F.coalesce(F.sum(F.when(month, F.col("latency_ms"))), F.lit(0.0)).alias("ms"), F.count_if(F.col("started_at") >= now - F.expr("interval 24 hours")).alias("runs_24h"))
    pct = F.round(100 * F.col("ms") / 60_000 / minutes_limit, 2)
    return g.select(F.round(F.col("ms") / 60_000, 4).alias("minutes"), "runs_24h", pct.alias("minutes_pct"), F.round(100 * F.col("runs_24h") / runs_limit, 2).alias("runs_pct"),
                    F.when(pct >= 90, "critical").when(pct >= 80, "warning").when(pct >= 70, "notice").otherwise("ok").alias("level"))


def workflow_minutes(runs: DataFrame, limit: float = 2000) -> DataFrame:
    """Minutes of successful runs by workflow, their share and label, what remains."""
    g = runs.filter("conclusion = 'success'").groupBy("workflow").agg(F.sum("minutes").alias("minutes"))
    total = g.agg(F.sum("minutes").alias("total"))
    share = F.col("minutes") / F.col("total")
    return g.crossJoin(F.broadcast(total)).select(  # one row
        "workflow", F.round("minutes", 4).alias("minutes"), F.round("total", 4).alias("total"), F.round(F.lit(limit) - F.col("total"), 4).alias("remaining"),
        F.when(share > 0.3, "high").when(share > 0.1, "medium").otherwise("low").alias("share"))


def zero_delete_streak(log: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive maintenance runs that deleted nothing, by job: the current
    one's length and whether it alerts."""
    w = Window.partitionBy("job").orderBy("ran_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    isle = log.withColumn("island", F.sum((F.col("deleted") > 0).cast("int")).over(w))
    last = isle.groupBy("job").agg(F.max("island").alias("island"))
    g = isle.join(last, ["job", "island"]).groupBy("job").agg(F.count_if(F.col("deleted") == 0).alias("streak"))
    return g.withColumn("alert", F.col("streak") >= least)


def heal_candidates(stores: DataFrame, logs: DataFrame, events: DataFrame, now: Column, idle_days: int = 15, least_items: int = 1) -> DataFrame:
    """Inactive stores with a decision: missing_facts (no logs), skipped (disabled
    recently, or no recent success) or reactivated. Of a store's newest three runs
    one must have succeeded within idle_days, and its disabling must be older."""
    cutoff = now - F.expr(f"interval {idle_days} days")
    ok = (F.col("status") == "completed") & (F.coalesce("items_found", F.lit(0)) >= least_items) & (F.col("started_at") > cutoff)
    runs = last_runs(logs, 3).groupBy("store_name").agg(F.max(ok).alias("success"))
    off = events.filter("event_type = 'auto_disabled'").groupBy(F.col("scraper_name").alias("store_name")).agg(F.max("created_at").alias("disabled_at"))
    s = stores.filter(~F.col("is_active")).select(F.col("name").alias("store_name")).join(runs, "store_name", "left").join(off, "store_name", "left")
    recent = F.col("disabled_at").isNull() | (F.col("disabled_at") > cutoff)
    decision = F.when(F.col("success").isNull(), "missing_facts").when(recent | ~F.col("success"), "skipped").otherwise("reactivated")
    reason = F.when(F.col("success").isNull(), None).when(recent, "disabled_recently").when(~F.col("success"), "no_recent_success_log")
    return s.select("store_name", decision.alias("decision"), reason.alias("reason"))


def pending_by_store(queue: DataFrame) -> DataFrame:
    return queue.filter("status = 'pending'").groupBy("store_name").agg(F.count("*").alias("pending")).orderBy(F.desc("pending"), "store_name")


def registry_kpis(registry: DataFrame) -> DataFrame:
    test = F.lower("name").rlike("^(cleanup store |test |e2e |_test_|ocr test )")
    return registry.agg(F.count_if(F.col("status") == "pending_review").alias("pending"), F.count_if(F.coalesce("address", F.lit("")) != "").alias("with_address"),
                        F.count_if(F.col("matched_store_id").isNotNull()).alias("matched"), F.count_if(test).alias("test_junk"), F.count_if(~T.is_food_store(F.col("name"))).alias("non_food"))


def discovered_product_count(registry: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct ingredients priced by registry entry: by matched store id, else name."""
    by_id = prices.groupBy("store_id").agg(F.countDistinct("ingredient_id").alias("by_id"))
    by_name = prices.groupBy("store_name").agg(F.countDistinct("ingredient_id").alias("by_name"))
    r = registry.join(by_id, F.col("matched_store_id") == F.col("store_id"), "left").join(by_name, F.col("name") == F.col("store_name"), "left")
    n = F.coalesce(F.when(F.col("matched_store_id").isNotNull(), F.col("by_id")), "by_name", F.lit(0))
    return r.select("id", "name", "status", "source", "matched_store_id", n.alias("products"))
