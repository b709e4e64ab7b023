"""The functions that SQL can call: temporary ones of the session.

`register` makes them once; each has a twin among the column functions or operators,
whose results it gives. Scalar functions are SQL expressions, except the two
similarities, which are Arrow-batched. The table functions read the session's views
`prices` and `stores`, as their twins read tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T
from .similarity import lcs_of


def _fuzz_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else 200.0 * lcs_of(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b)], dtype="float64")


def _token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _by_words(set(x.split()), set(y.split())) for x, y in zip(a, b)], dtype="float64")


def _by_words(a: set[str], b: set[str]) -> float:
    """token_set_ratio of similarity.py, of two sets of words."""
    if not a or not b:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (a & b, a - b, b - a))
    if both and not (left and right):
        return 100.0
    common = len(both) + 1 if both else 0
    lcs = lcs_of(left, right)
    ratios = [200.0 * (common + lcs) / (2 * common + len(left) + len(right))]
    return max(ratios + [200.0 * len(both) / (2 * len(both) + 1 + len(x)) for x in (left, right) if both])


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _pack() -> str:
    """The first weight pattern with a number: its count, weight and measure."""
    one, two, three = map(_raw, T.WEIGHTS)

    def part(p: str, q: str, w: int, m: int) -> str:
        return (f"CASE WHEN try_cast(regexp_extract(u, {p}, {w}) AS DOUBLE) IS NOT NULL AND regexp_like(u, {p}) "
                f"THEN named_struct('q', {q}, 'w', try_cast(regexp_extract(u, {p}, {w}) AS DOUBLE), 'm', lower(regexp_extract(u, {p}, {m}))) END")

    counted = "try_cast(regexp_extract(u, {}, 1) AS INT)"
    return f"coalesce({part(one, counted.format(one), 2, 3)}, {part(two, '1', 1, 2)}, {part(three, counted.format(three), 2, 3)})"


def statements() -> list[str]:
    counts = ", ".join(f"CASE WHEN regexp_like(u, {_raw(p)}) THEN try_cast(regexp_extract(u, {_raw(p)}, 1) AS INT) END" for p in reversed(T.COUNTS))
    whole = "named_struct('qty', n, 'unit_kg', kg, 'total_kg', n * kg, 'price_per_kg', round(round(price / (n * kg), 4), 2), 'price_per_un', round(round(price / n, 4), 2))"
    scalar = {
        "deaccent(text STRING) RETURNS STRING": f"translate(text, {_text(T._ACCENTED)}, {_text(T._PLAIN)})",
        "clean_text(text STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(upper(text), r'[^A-Z0-9\s]', ''), r'\s+', ' '))",
        "normalize_store_name(name STRING) RETURNS STRING": "regexp_replace(upper(name), '[^A-Z0-9 ]', '')",
        "default_scrape_frequency_minutes(tier INT) RETURNS INT": "CASE tier WHEN 1 THEN 10080 WHEN 4 THEN 43200 ELSE 1440 END",
        "unit_pack(u STRING) RETURNS STRUCT<q: INT, w: DOUBLE, m: STRING>": _pack(),
        "unit_count(u STRING) RETURNS INT": f"coalesce({counts})",
        "priced_pack(price DOUBLE, n INT, kg DOUBLE) RETURNS STRUCT<qty: INT, unit_kg: DOUBLE, total_kg: DOUBLE, price_per_kg: DOUBLE, price_per_un: DOUBLE>":
            f"CASE WHEN price > 0 AND n * kg > 0 THEN {whole} END",
        "pack_in_kg(p STRUCT<q: INT, w: DOUBLE, m: STRING>) RETURNS DOUBLE": "CASE WHEN p.m IN ('kg', 'litro', 'litros') THEN p.w ELSE p.w / 1000 END",
        "normalize_price(price DOUBLE, unit STRING) RETURNS STRUCT<qty: INT, unit_kg: DOUBLE, total_kg: DOUBLE, price_per_kg: DOUBLE, price_per_un: DOUBLE>":
            "priced_pack(price, coalesce(unit_count(regexp_replace(trim(unit), ',', '.')), unit_pack(regexp_replace(trim(unit), ',', '.')).q), pack_in_kg(unit_pack(regexp_replace(trim(unit), ',', '.'))))",
    }
    own, asked = "normalize_store_name(s.name)", "normalize_store_name(find_similar_store.asked)"
    alike = f"1 - levenshtein({own}, {asked}) / greatest(length({own}), length({asked}), 1)"
    edited = "CASE WHEN find_similar_store.least < 1 THEN find_similar_store.least / (1 - find_similar_store.least) - 0.000001D ELSE 2147483647D END"
    table = {
        "detect_price_outliers(as_of DATE, days INT, threshold DOUBLE) RETURNS TABLE(id STRING, ingredient_id STRING, price_per_kg DOUBLE, zscore DOUBLE)":
            """SELECT p.id, p.ingredient_id, p.price_per_kg, (p.price_per_kg - s.mean) / s.std FROM prices p JOIN (
                 SELECT ingredient_id, avg(price_per_kg) AS mean, stddev_samp(price_per_kg) AS std FROM prices
                 WHERE price_per_kg > 0 AND to_date(collected_at) >= date_sub(detect_price_outliers.as_of, detect_price_outliers.days) GROUP BY ingredient_id HAVING stddev_samp(price_per_kg) > 0) s
               ON p.ingredient_id = s.ingredient_id
               WHERE p.price_per_kg > 0 AND to_date(p.collected_at) >= date_sub(detect_price_outliers.as_of, detect_price_outliers.days) AND abs((p.price_per_kg - s.mean) / s.std) > detect_price_outliers.threshold""",
        "find_similar_store(asked STRING, least DOUBLE) RETURNS TABLE(id STRING, name STRING, similarity DOUBLE)":
            # equal names meet by a join; an edit only fits in names of least / (1 - least) letters
            f"""SELECT s.id, s.name, 1D AS similarity FROM stores s WHERE s.is_active AND {own} = {asked} AND find_similar_store.least <= 1
               UNION ALL SELECT s.id, s.name, {alike} FROM stores s WHERE s.is_active AND {own} <> {asked}
               AND length({own}) >= {edited} AND length({asked}) >= {edited} AND {alike} >= find_similar_store.least""",
    }
    make = "CREATE OR REPLACE TEMPORARY FUNCTION {} RETURN {}"
    return [make.format(k, v) for k, v in (scalar | table).items()]


def register(spark: SparkSession, tables: bool = True) -> None:
    """Make the functions known to the session's SQL; the table functions need the
    views `prices` and `stores` (tables False: without them)."""
    spark.udf.register("fuzz_ratio", F.pandas_udf(_fuzz_ratio, "double"))
    spark.udf.register("token_set_ratio", F.pandas_udf(_token_set_ratio, "double"))
    for s in statements():
        if tables or "RETURNS TABLE" not in s:
            spark.sql(s)
