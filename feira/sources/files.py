"""File sources and sinks with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

PRICE_ROW = ("id string, ingredient_id string, store_id string, store_name string, raw_product string, raw_unit string, raw_price double, "
                                 "price_per_kg double, collected_at timestamp, valid_from date, valid_until date, is_promotion boolean, tier int, confidence double, brand string")
MANUAL = ("ingredient string, store string, price string, unit string, collected_at string, brand string")
VISIT = ("ingredient string, store string, price string, unit string, city string")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Ingredient catalog from JSON lines; `canonical` is canonical_name."""
    schema = "canonical string, canonical_name string, category string, brands array<string>, search_terms array<string>, aliases array<string>, exclude_terms array<string>"
    return spark.read.schema(schema).json(path).withColumn("canonical_name", F.coalesce("canonical_name", "canonical")).drop("canonical")


def load_stores(stores: DataFrame, keys: list[str]) -> DataFrame:
    """Active stores by priority, with keys of the config map as columns; a column
    that is there and not null wins."""
    have = set(stores.columns)
    cols = {k: F.coalesce(F.col(k).cast("string"), F.col("config")[k]) if k in have else F.col("config")[k] for k in keys}
    return stores.filter("is_active").withColumns(cols).orderBy(F.asc_nulls_last("priority"), "name")


def import_manual_prices(spark: SparkSession, path: str, ingredients: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(price rows, error rows) of a CSV: an unknown ingredient or store or a bad price
    is an error, told with the row of its file (the header is row 1, blank lines don't
    count); tier 4 for stores named Manual, else 2; confidence 1."""
    raw = numbered_rows(spark.read.schema(MANUAL).option("header", True).option("mode", "PERMISSIVE").csv(path))
    i = ingredients.select(F.lower("canonical_name").alias("_i"), F.col("canonical_name").alias("ingredient_id"))
    s = stores.select(F.lower("name").alias("_s"), F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    x = raw.join(i, F.lower(F.trim("ingredient")) == F.col("_i"), "left").join(s, F.lower(F.trim("store")) == F.col("_s"), "left").drop("_i", "_s")
    price = F.replace(F.col("price"), F.lit(","), F.lit(".")).try_cast("double")
    x = x.withColumn("raw_price", price).withColumn("error", F.concat_ws("; ", F.when(F.col("ingredient_id").isNull(), "unknown ingredient"), F.when(F.col("store_id").isNull(), "unknown store"),
                                                                          F.when(~F.coalesce(price > 0, F.lit(False)), "bad price")))
    good = x.filter("error = ''").withColumn("normalized", T.normalize_price(F.col("raw_price"), F.col("unit"))).select(
        "ingredient_id", "store_id", "store_name", "raw_price", F.col("unit").alias("raw_unit"), F.coalesce(F.try_to_timestamp("collected_at"), F.lit(None)).alias("collected_at"), "brand",
        "normalized", F.lit(1.0).alias("confidence"), F.when(F.col("store_name").contains("Manual"), 4).otherwise(2).alias("tier"))
    return good, x.filter("error <> ''").select("row", "ingredient", "store", "price", "unit", "error")


def numbered_rows(lines: DataFrame) -> DataFrame:
    """Lines of text files with `row`, from 2 in each file. Files are read in blocks, in
    any order: a block's rows follow those of the blocks before it."""
    x = lines.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_at", F.monotonically_increasing_id())
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("_f", "_b").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return x.join(blocks, ["_f", "_b"]).withColumn("row", F.col("_before") + F.col("_at") - F.col("_first") + 2).drop("_f", "_b", "_at", "_first", "_n", "_before")


def import_visit_prices(spark: SparkSession, path: str, ingredients: DataFrame, city: str = "") -> DataFrame:
    """Rows of a field-visit sheet (CSV) as price rows of tier 2; rows with blanks, bad
    numbers or unknown ingredients go. The store id is its name as a slug."""
    raw = spark.read.schema(VISIT).option("header", True).csv(path)
    price = F.replace(F.col("price"), F.lit(","), F.lit(".")).try_cast("double")
    x = raw.withColumn("raw_price", price).filter("raw_price > 0 and trim(ingredient) <> '' and trim(store) <> '' and trim(unit) <> ''")
    i = ingredients.select(F.lower("canonical_name").alias("_i"), F.col("canonical_name").alias("ingredient_id"))
    slug = F.trim(F.regexp_replace(F.lower(T.deaccent(F.trim("store"))), "[^a-z0-9]+", "_"), F.lit("_"))
    return x.join(i, F.lower(F.trim("ingredient")) == F.col("_i")).select("ingredient_id", slug.alias("store_id"), F.col("store").alias("store_name"), "raw_price", F.col("unit").alias("raw_unit"),
                                                                        F.lit(2).alias("tier"), F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.lit(city)).alias("city"))


def report_sink(report: DataFrame, path: str, form: str = "parquet") -> None:
    report.write.mode("overwrite").format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)


def generate_prices(spark: SparkSession, ingredients: int, stores: int, days: int, seed: int = 1) -> DataFrame:
    """Synthetic prices for scale tests: a bounded random-walk trend by ingredient and
    day, about 70 of 100 days, 30 of 100 stores, 8 of 100 on promotion."""
    cell = spark.range(ingredients * stores * days)
    ing, rest = F.col("id") % ingredients, F.floor(F.col("id") / ingredients)
    x = cell.select(ing.alias("i"), (rest % stores).alias("s"), F.floor(rest / stores).alias("d"))
    part = lambda *k: F.pmod(F.xxhash64(*[F.col(c) for c in k], F.lit(seed)), F.lit(10_000)) / 10_000.0
    x = x.filter((part("i", "d") < 0.7) & (part("i", "s") < 0.3))
    trend = F.greatest(F.lit(0.8), F.least(F.lit(1.2), 1 + 0.15 * F.sin(F.col("d") / 30.0 + part("i") * 6.28) + 0.05 * (part("i", "s", "d") - 0.5)))
    promo = part("s", "i", "d") < 0.08
    return x.select(F.concat(F.lit("Ingredient "), F.col("i").cast("string")).alias("ingredient_id"), F.col("s").alias("store_id"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("d").cast("int")).alias("collected_at"),
                    F.round((5 + 40 * part("i")) * trend * F.when(promo, 0.8).otherwise(1.0), 2).alias("price_per_kg"), promo.alias("is_promotion"), (1 + F.col("s") % 4).alias("tier"))
