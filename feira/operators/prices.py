"""Current prices: validity, search, history, latest prices and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def valid_at(prices: DataFrame, as_of: Column) -> DataFrame:
    """Prices whose validity holds the day (both ends count); null ends never hold."""
    return prices.filter((F.col("valid_from") <= as_of) & (F.col("valid_until") >= as_of))


def search_prices(prices: DataFrame, as_of: Column, ingredient: str, sort_by: str = "price_per_kg", descending: bool = False, limit: int = 50,
                  tier: int | None = None, valid_only: bool = True) -> DataFrame:
    """An ingredient's prices in order, nulls last going up and first going down;
    ties by id. One TakeOrdered, never a full sort."""
    p = prices.filter(F.col("ingredient_id") == ingredient)
    p = p if tier is None else p.filter(F.col("tier") == tier)
    p = valid_at(p, as_of) if valid_only else p
    return p.orderBy(F.desc_nulls_first(sort_by) if descending else F.asc_nulls_last(sort_by), "id").limit(limit)


def price_history(prices: DataFrame, as_of: Column, ingredient: str, days: int = 90, valid_only: bool = False) -> DataFrame:
    """An ingredient's prices of the last days, newest first."""
    p = prices.filter((F.col("ingredient_id") == ingredient) & (F.to_date("collected_at") >= F.date_sub(as_of, days)))
    return (valid_at(p, as_of) if valid_only else p).orderBy(F.desc("collected_at"), "id")


def latest_prices(prices: DataFrame, as_of: Column) -> DataFrame:
    """The newest valid row of positive price per kg of each (ingredient, store).
    The newest is a partial aggregate, so no store's history is gathered."""
    p = valid_at(prices, as_of).filter("price_per_kg > 0")
    row = F.struct(*p.columns)
    best = p.groupBy("ingredient_id", "store_id").agg(F.max_by(row, F.struct("collected_at", "id")).alias("r"))
    return best.select("r.*")


def newest_prices(prices: DataFrame) -> DataFrame:
    """The newest row of each (ingredient, store) whether or not it is still valid."""
    p = prices.filter("price_per_kg > 0")
    best = p.groupBy("ingredient_id", "store_id").agg(F.max_by(F.struct(*p.columns), F.struct("collected_at", "id")).alias("r"))
    return best.select("r.*")


def prices_view(prices: DataFrame, as_of: Column, ingredient: str, tier: int | None = None) -> DataFrame:
    """One ingredient's valid prices with a freshness label, cheapest first."""
    p = valid_at(prices, as_of).filter(F.col("ingredient_id") == ingredient)
    p = p if tier is None else p.filter(F.col("tier") == tier)
    return p.withColumn("freshness", T.freshness_bucket(F.to_date("collected_at"), as_of)).orderBy("price_per_kg", "id")


def active_promotions(prices: DataFrame) -> DataFrame:
    return prices.filter("is_promotion")


def promotions_view(prices: DataFrame, stores: list | None = None, ingredients: list | None = None, order: str = "price") -> DataFrame:
    """Promotions of positive price per kg, by price, store or newest first."""
    p = prices.filter("is_promotion and price_per_kg > 0")
    p = p.filter(F.col("store_name").isin(stores)) if stores else p
    p = p.filter(F.col("ingredient_id").isin(ingredients)) if ingredients else p
    by = {"price": F.asc("price_per_kg"), "store": F.asc("store_name"), "newest": F.desc("collected_at")}[order]
    return p.orderBy(by, "id")


def promotions_kpis(prices: DataFrame) -> DataFrame:
    p = prices.filter("is_promotion and price_per_kg > 0")
    return p.agg(F.count("*").alias("promotions"), F.round(F.avg("price_per_kg"), 4).alias("avg_ppk"), F.max("collected_at").alias("last_collected"))


def active_stores(stores: DataFrame, tier: int | None = None) -> DataFrame:
    s = stores.filter("is_active")
    return s if tier is None else s.filter(F.col("tier") == tier)


def store_name_filter(stores: DataFrame, terms: list[str]) -> DataFrame:
    """Stores whose name has one of the terms and none of those that begin with '-'
    (no plain term: all), whatever the case."""
    terms = [t.strip().lower() for t in terms if t.strip()]
    out, name = stores, F.lower("name")
    if include := [t for t in terms if not t.startswith("-")]:
        out = out.filter(T.contains_any(name, include))
    if exclude := [t[1:].strip() for t in terms if t.startswith("-") and t[1:].strip()]:
        out = out.filter(~T.contains_any(name, exclude))
    return out


def feature_gate(keys: DataFrame, flags: DataFrame, key: str, default: bool) -> DataFrame:
    """enabled of each ingredient: its own flag ('key:ingredient'), else the global
    one, else the default."""
    own = flags.select(F.col("key").alias("own_key"), F.col("enabled").alias("own"))
    both = flags.filter(F.col("key") == key).agg(F.max("enabled").alias("all"))
    return (keys.join(own, F.concat_ws(":", F.lit(key), "ingredient_id") == F.col("own_key"), "left").crossJoin(F.broadcast(both))  # one row
            .select("ingredient_id", F.coalesce("own", "all", F.lit(default)).alias("enabled")))


def flyers_recent(flyers: DataFrame, as_of: Column, days: int = 30, source: str | None = None) -> DataFrame:
    f = flyers.filter(F.to_date("collected_at") >= F.date_sub(as_of, days))
    return (f if source is None else f.filter(F.col("source") == source)).orderBy(F.desc("collected_at"), "id")


def flyers_pending(flyers: DataFrame, limit: int = 50) -> DataFrame:
    return flyers.filter("ocr_status = 'pending'").orderBy(F.desc("collected_at"), "id").limit(limit)


def review_filter(queue: DataFrame, min_confidence: float = 0.0, match_type: str | None = None) -> DataFrame:
    q = queue.filter(F.col("confidence") >= min_confidence)
    return q if match_type is None else q.filter(F.col("match_type") == match_type)


def review_kpis(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.6).alias("high"), F.count_if(F.col("confidence") < 0.4).alias("low"))


def out_of_scope_products(queue: DataFrame, rules: DataFrame) -> DataFrame:
    """Queue rows that their store's rule rejects: no wanted term, or a junk term.
    rules: store_name, wanted, junk (arrays of lower-case terms; one row a store)."""
    low = F.lower("raw_product")
    hit = lambda c: F.exists(c, lambda t: low.contains(t))
    return (queue.join(rules, "store_name").filter(~hit(F.col("wanted")) | hit(F.col("junk"))).drop("wanted", "junk"))


def false_positive_prices(prices: DataFrame, patterns: list[str], whitelist: list[str]) -> DataFrame:
    """Every row with is_false_positive: a non-food pattern and no whitelisted one."""
    low = F.lower("raw_product")
    bad = T.contains_any(low, patterns) & ~(T.contains_any(low, whitelist) if whitelist else F.lit(False))
    return prices.withColumn("is_false_positive", F.coalesce(bad, F.lit(False)))


def stores_with_frequency(stores: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Stores with their collection frequency (one row a store; null when none)."""
    return stores.join(frequencies, stores["id"] == frequencies["store_id"], "left").drop("store_id")


def collectable_stores(stores: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Active stores without a frequency row, or with an enabled one."""
    f = frequencies.select("store_id", "enabled")
    return (stores.filter("is_active").join(f, stores["id"] == f["store_id"], "left")
            .filter(F.coalesce("enabled", F.lit(True))).drop("store_id", "enabled"))


def union_collections(*parts: DataFrame) -> DataFrame:
    """Product rows of all collectors; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def page_rows(rows: DataFrame, keys: list[str], page: int, size: int = 15) -> DataFrame:
    """Page (from 1) of an ordered list; keys must order totally. The list up to the
    page is one TakeOrdered; only its last page is numbered."""
    upto = rows.orderBy(*keys).limit(page * size)
    order = Window.orderBy(*keys)
    return upto.withColumn("row", F.row_number().over(order)).filter(F.col("row") > (page - 1) * size)
