"""The collection run as one plan: raw products -> routed rows -> table states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import match
from ..sources.work import kept


def collection_run(products: DataFrame, catalog: DataFrame, stores: DataFrame, now: Column, review: float = 0.70, semantics: DataFrame | None = None,
                   cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(price rows, review rows) of products (id, raw_product, raw_price, raw_unit,
    store_name; brand with a cache): gate by keywords, match, route. semantics
    (raw_product, ingredient, semantic): similarity of meaning, where known; cache:
    earlier decisions, see match.decision_cache.

    What only the text decides is worked out once for each text; the products are read
    for their texts and for the result."""
    texts = match.distinct_texts(products)
    gated = match.keyword_gate(texts.withColumn("id", F.col("raw_product")), catalog).select("raw_product")
    found = match.match_ingredient(gated, catalog, threshold=60.0)
    if semantics is None:
        found = found.withColumn("semantic", F.lit(0.0))
    else:
        found = found.join(semantics.groupBy("raw_product", "ingredient").agg(F.max("semantic").alias("semantic")), ["raw_product", "ingredient"], "left")
    found = kept(found, "found")
    rows = products.join(found, "raw_product")
    if cache is not None:
        rows = match.decision_cache(rows, cache, now).drop("key", "cached_ingredient")
    routed = match.route_match(rows, review=review)
    # a cached decision only spares a text the review, so these are all that get there
    asked = match.route_match(found, review=review).filter("route = 'review'")
    told = kept(match.match_reason(match.rank_ingredients(asked, catalog)).select("raw_product", "top", "suggestions", "match_type", "match_reason"), "reasons")
    return match.build_price_rows(routed.filter("route = 'accept'"), stores, now), routed.filter("route = 'review'").drop("match_type").join(told, "raw_product")
