"""Queries of offer parsing, flyer geometry and the store registry. Shop responses,
pages and read flyers are built from the driver's line items, one for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import extract as X
from .operators import maintain as M
from .queries import _flyers, _registry, query
from .sources import bind


def _lines(s, d) -> DataFrame:
    t = lambda n: bind.read_table(s, d, n)
    l = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.withColumn("price", F.col("l_extendedprice").cast("double")).withColumn("stock", F.col("l_suppkey") % 4)


def _orders(lines: DataFrame, item, key: str) -> DataFrame:
    """A document for each order: the struct of its items under a key (seven at most)."""
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias(key))


_JOIN = "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


@query(f"""SELECT l_orderkey AS id, CASE WHEN l_partkey % 9 = 1 THEN 'Kit {{{{2}}}} ' ELSE '' END || p_name || ' ' || p_brand AS name, CASE WHEN l_linenumber % 3 = 1 THEN l_extendedprice + 1 ELSE l_extendedprice END AS price {_JOIN}
WHERE (l_linenumber % 3 = 1 OR l_suppkey % 4 <> 1) AND l_partkey % 9 <> 0 AND l_suppkey % 11 <> 0 AND l_orderkey % 13 <> 0""")
def jsonld_products(s, d):
    # low prices, those of zero and none; prices of zero; placeholders and braces in names; items that only name themselves; prices as text, which end a block
    own = F.when(F.col("stock") != 1, F.col("price")).otherwise(0.0)
    low = F.when(F.col("l_linenumber") % 3 == 1, F.col("price") + 1).when(F.col("l_linenumber") % 3 == 0, 0.0)
    name = F.when(F.col("l_partkey") % 9 == 0, " Lançamento\n\n").otherwise(F.concat(F.when(F.col("l_partkey") % 9 == 1, "Kit {{2}} ").otherwise(""), F.concat_ws(" ", "p_name", "p_brand")))
    part = F.col("l_suppkey") % 11 == 0
    text = F.col("l_orderkey") % 13 == 0
    offers = F.struct(F.when(~text, low).alias("lowPrice"), F.when(~text, own).alias("price"))
    item = F.struct(F.when(part, name).alias("name"), F.when(~part, F.struct(name.alias("name"), offers.alias("offers"))).alias("item"))
    words = F.struct(F.struct(F.lit("Text").alias("name"), F.struct(F.lit("12.90").alias("price")).alias("offers")).alias("item"))
    p = _orders(_lines(s, d), item, "itemListElement").select("id", F.to_json(F.struct(F.lit("ItemList").alias("@type"), "itemListElement")).alias("json"))
    p = p.withColumn("json", F.when(F.col("id") % 13 == 0, F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.array(words).alias("itemListElement")))).otherwise(F.col("json")))
    html = F.concat(F.lit('<html><script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json">'), F.col("json"), F.lit("</script></html>"))
    return X.jsonld_products(p.select("id", html.alias("html"))).select("id", "name", "price")


@query(f"""SELECT l_orderkey AS id, p_name AS name, p_brand AS brand, CASE WHEN l_suppkey % 4 = 2 THEN l_extendedprice + 1 ELSE l_extendedprice END AS price, CASE WHEN l_suppkey % 4 = 2 THEN 'large' ELSE 'small' END AS variant {_JOIN}
WHERE l_suppkey % 4 <> 1 AND l_partkey % 9 <> 0""")
def shopify_products(s, d):
    # the second variant is the available one for a quarter of the products, another quarter doesn't say, one costs nothing; blank titles
    price = F.when(F.col("stock") == 1, F.lit(0.0)).otherwise(F.col("price"))
    v = lambda title, p, ok: F.struct(F.lit(title).alias("title"), p.cast("string").alias("price"), ok.alias("available"))
    small = F.when(F.col("stock") == 2, False).when(F.col("stock") == 3, True)
    title = F.when(F.col("l_partkey") % 9 == 0, " \n").otherwise(F.concat(F.lit(" "), "p_name"))
    item = F.struct(title.alias("title"), F.col("p_brand").alias("vendor"), F.array(v("small", price, small), v("large", price + F.when(F.col("stock") == 1, 0).otherwise(1), F.lit(True))).alias("variants"))
    return X.shopify_products(_orders(_lines(s, d), item, "products").select("id", F.to_json(F.struct("products")).alias("json"))).select("id", "name", "brand", "price", "variant")


_OFFER = """CASE l_partkey % 3 WHEN 0 THEN p_name || ' ' || p_brand || ' 1kg' WHEN 1 THEN p_brand ELSE p_name END AS name, CASE WHEN l_partkey % 3 < 2 THEN p_brand ELSE 'declared' END AS brand, CASE WHEN l_partkey % 3 = 0 THEN '1kg' ELSE '' END AS unit"""


@query(f"""SELECT l_orderkey AS id, {_OFFER}, s_name AS seller, l_extendedprice AS price, l_suppkey % 4 AS quantity, '2026-05-01' AS validity_raw {_JOIN} WHERE l_suppkey % 4 > 0
UNION ALL SELECT l_orderkey, {_OFFER}, 'other', l_extendedprice + 2, 5, '' {_JOIN} WHERE l_partkey % 2 = 0""")
def vtex_offers(s, d):
    offer = lambda price, n, until: F.struct(price.alias("Price"), n.cast("long").alias("AvailableQuantity"), until.alias("priceValidUntil"))
    seller = lambda name, o: F.struct(name.alias("sellerName"), o.alias("commertialOffer"))
    sellers = F.array(seller(F.col("s_name"), offer(F.col("price"), F.col("stock"), F.lit("2026-05-01"))), seller(F.lit("other"), offer(F.when(F.col("l_partkey") % 2 == 0, F.col("price") + 2).otherwise(0.0), F.lit(5), F.lit(None).cast("string"))))
    k = F.col("l_partkey") % 3
    names = F.struct(F.when(k == 0, F.concat_ws(" ", "p_name", "p_brand", F.lit("1kg"))).alias("nameComplete"), F.when(k == 1, F.col("p_brand")).when(k == 0, "short").alias("name"), sellers.alias("sellers"))
    item = F.struct(F.col("p_name").alias("productName"), F.lit("declared").alias("brand"), F.array(names).alias("items"))
    lines = _lines(s, d)
    answers = _orders(lines, item, "p").select("id", F.to_json("p").alias("json"), F.lit("any").alias("ingredient"))
    catalog = bind.read_table(s, d, "part").select(F.lit("any").alias("canonical_name"), "p_brand").distinct().groupBy("canonical_name").agg(F.array_sort(F.collect_list("p_brand")).alias("brands"))
    return X.vtex_offers(answers, catalog).select("id", "name", "brand", "unit", "seller", "price", "quantity", "validity_raw")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Rua das Flores, ' || c_custkey WHEN 1 THEN 'CEP 11010-123' WHEN 2 THEN 'Tel 1398765-4321; Vila Nova' END AS address,
CASE c_custkey % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 8.0 WHEN 2 THEN 5.5 END AS confidence, CASE c_custkey % 4 WHEN 0 THEN 'rua_com_numero' WHEN 1 THEN 'cep' WHEN 2 THEN 'combinado' END AS kind FROM customer""")
def best_address(s, d):
    c, k = bind.read_table(s, d, "customer"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Visite: Rua das Flores, "), F.col("c_custkey").cast("string"))).when(k == 1, "entrega CEP 11010-123").when(k == 2, "Vila Nova\nTel 1398765-4321").otherwise("nada aqui")
    best = X.best_address(X.extract_addresses(c.select(F.col("c_custkey").alias("id"), text.alias("text"))))
    # the two clues of the third kind, whatever their order
    many = F.when(F.col("kind") == "combinado", F.array_join(F.array_sort(F.split("address", "; ")), "; ")).otherwise(F.col("address"))
    return best.select("id", many.alias("address"), "confidence", "kind")


@query("SELECT p_partkey AS id, left(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type, 80) AS name FROM part")
def name_from_texts(s, d):
    p = bind.read_table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), X.name_from_texts(F.array("p_name", F.lit("x"), "p_type", F.lit(" "), "p_brand", "p_name", "p_type")).alias("name"))


# Read flyers: a column of regions for each line item, 400 apart

def _regions(s, d) -> DataFrame:
    """Per line: reais and cents of the price, a second and lower price under it for
    odd parts, and the product's name above."""
    x = F.row_number().over(Window.partitionBy("flyer_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) * 400.0
    box = lambda cx, cy, h: F.array(*[F.array(cx + dx, F.lit(cy + dy)) for dx, dy in ((-20.0, -h / 2), (20.0, -h / 2), (20.0, h / 2), (-20.0, h / 2))])
    region = lambda text, cx, cy, h: F.struct(text.alias("text"), box(cx, cy, h).alias("box"), F.lit(0.9).alias("score"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    own = F.array_compact(F.array(region((10 + F.col("l_partkey") % 80).cast("string"), F.col("x"), 100.0, 80.0), region(two(F.col("l_suppkey") % 100), F.col("x") + 60, 90.0, 40.0), region(F.col("p_name"), F.col("x"), 60.0, 20.0),
                                  F.when(F.col("l_partkey") % 2 == 1, region(F.lit("5"), F.col("x"), 200.0, 70.0))))
    # dealt by flyer once: what follows needs them in the same way
    placed = _lines(s, d).withColumn("flyer_id", F.col("l_orderkey").cast("string")).withColumn("x", x)
    return placed.select("flyer_id", F.explode(own).alias("r")).select("flyer_id", "r.*")


_REGION = f""", l AS (SELECT l_orderkey::VARCHAR AS flyer_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) * 400.0::DOUBLE AS x, 10 + l_partkey % 80 + (l_suppkey % 100) / 100 AS high, l_partkey % 2 = 1 AS two, p_name {_JOIN}),
p AS (SELECT flyer_id, x AS cx, 100.0::DOUBLE AS cy, round(high, 2) AS price, 'cents' AS how FROM l UNION ALL SELECT flyer_id, x, 200.0::DOUBLE, 5.0::DOUBLE, 'no_cents' FROM l WHERE two),
low AS (SELECT flyer_id, x AS cx, CASE WHEN two THEN 200.0::DOUBLE ELSE 100.0::DOUBLE END AS cy, CASE WHEN two THEN 5.0::DOUBLE ELSE round(high, 2) END AS price, p_name FROM l) """


@query(_REGION + "SELECT flyer_id, cx, cy, price, how FROM p")
def region_prices(s, d):
    return X.region_prices(_regions(s, d), dealt=True).withColumn("price", F.round("price", 2))


@query(_REGION + "SELECT flyer_id, cx, cy, price FROM low")
def dual_price_dedup(s, d):
    return X.dual_price_dedup(_regions(s, d), dealt=True).select("flyer_id", "cx", "cy", F.round("price", 2).alias("price"))


@query(_REGION + "SELECT p.flyer_id, p.price, p.cx, p.cy, l.p_name AS name_text FROM p JOIN l ON p.flyer_id = l.flyer_id AND p.cx = l.x")
def box_join(s, d):
    r = _regions(s, d)
    return X.box_join(X.region_prices(r, dealt=True), r.filter("text rlike '[a-z]{3}'")).select("flyer_id", F.round("price", 2).alias("price"), "cx", "cy", "name_text")


@query(_REGION + "SELECT flyer_id, price, [p_name] AS texts FROM low")
def price_blocks(s, d):
    # beside each name a phrase that is none
    r = _regions(s, d)
    phrase = F.element_at(F.array(*map(F.lit, ("sai por", "unidade", "o kg", "abc", "12345 abcd 678"))), (F.length("text") % 5 + 1).cast("int"))
    return X.price_blocks(r.unionByName(r.filter("text rlike '[a-z]{3}'").withColumn("text", phrase)), dealt=True)


@query(_REGION + """, h AS (SELECT flyer_id, median(h) AS height FROM (SELECT flyer_id, unnest(CASE WHEN two THEN [80, 40, 20, 70] ELSE [80, 40, 20] END)::DOUBLE AS h FROM l) GROUP BY 1),
f AS (SELECT flyer_id, count(*)::DOUBLE AS c, CASE WHEN bool_and(two) OR NOT bool_or(two) THEN 150.0::DOUBLE ELSE 100.0::DOUBLE END AS rows, 1000.0::DOUBLE * count(*) / (3 * count(*) + count(*) FILTER (two)) AS density FROM l GROUP BY 1),
one AS (SELECT *, least(80, greatest(30, rows * 0.8::DOUBLE)) AS gap1, CASE WHEN c > 4 THEN greatest(150, 1000 / c) ELSE 250 END AS x1 FROM f JOIN h USING (flyer_id)),
two AS (SELECT *, CASE WHEN density > 100 THEN greatest(30, gap1 * 0.7::DOUBLE) WHEN density < 20 THEN least(100, gap1 * 1.3::DOUBLE) ELSE gap1 END AS gap2, CASE WHEN density > 100 THEN greatest(150, x1 * 0.8::DOUBLE) ELSE x1 END AS x2 FROM one)
SELECT flyer_id, round(CASE WHEN height < 15 THEN greatest(20, gap2 * 0.8::DOUBLE) WHEN height > 30 THEN least(100, gap2 * 1.2::DOUBLE) ELSE gap2 END, 4) AS gap,
  round(CASE WHEN height < 15 THEN greatest(100, x2 * 0.8::DOUBLE) WHEN height > 30 THEN least(400, x2 * 1.2::DOUBLE) ELSE x2 END, 4) AS x_gap,
  CASE WHEN c > 4 THEN least(300, 200 + 50 * c) ELSE 260 END AS block_dx, least(400, greatest(200, rows * 2.5::DOUBLE)) AS above, 40.0::DOUBLE AS below, CASE WHEN density > 100 THEN 4 WHEN density < 20 THEN 8 ELSE 6 END AS most FROM two""")
def clustering_params(s, d):
    p = X.clustering_params(X.layout_profile(_regions(s, d), dealt=True))
    return p.select("flyer_id", *[F.round(c, 4).alias(c) for c in ("gap", "x_gap", "block_dx", "above")], "below", "most")


@query(_REGION + """SELECT flyer_id, (3 * count(*) + count(*) FILTER (two))::BIGINT AS region_count, count(*) AS price_count, count(*) AS columns, CASE WHEN count(*) > 1 THEN median(gap) ELSE 0.0 END AS col_gap,
CASE WHEN bool_and(two) OR NOT bool_or(two) THEN 150.0 ELSE 100.0 END AS row_gap FROM (SELECT *, x - lag(x) OVER (PARTITION BY flyer_id ORDER BY x) AS gap FROM l) GROUP BY 1""")
def layout_profile(s, d):
    out = X.layout_profile(_regions(s, d), dealt=True)
    return out.select("flyer_id", "region_count", F.col("price_count").cast("long").alias("price_count"), F.col("columns").cast("long").alias("columns"), "col_gap", "row_gap")


# Registry and flyers

#: Store names of flyers: known stores, registry entries, tests, shops without food, and new ones.
_NAMES = """CASE o_custkey % 6 WHEN 0 THEN 'Supplier#' || lpad((o_custkey % 90 + 1)::VARCHAR, 9, '0') WHEN 1 THEN 'Test Mercado' WHEN 2 THEN 'Farmácia ' || o_custkey WHEN 3 THEN 'CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0')
  ELSE 'Mercado Novo ' || o_custkey END"""


def _named_flyers(s, d) -> DataFrame:
    k, name = F.col("o_custkey") % 6, F.col("o_custkey")
    number = lambda c: F.lpad(c.cast("string"), 9, "0")
    store = (F.when(k == 0, F.concat(F.lit("Supplier#"), number(name % 90 + 1))).when(k == 1, "Test Mercado").when(k == 2, F.concat(F.lit("Farmácia "), name.cast("string")))
             .when(k == 3, F.concat(F.lit("CUSTOMER#"), number(name))).otherwise(F.concat(F.lit("Mercado Novo "), name.cast("string"))))
    o = bind.read_table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), store.alias("store_name"), F.col("o_orderpriority").alias("region"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("image_hash"),
                    F.when(F.col("o_orderkey") % 2 == 0, "Rua A, 1").alias("address"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_custkey % 6 NOT IN (1, 2)")
def purge_non_food_flyers(s, d):
    return M.purge_non_food_flyers(_named_flyers(s, d)).select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'processed' END AS ocr_status FROM orders""")
def upsert_flyers(s, d):
    f = _named_flyers(s, d).withColumn("image_hash", F.col("id").cast("string"))
    old = f.withColumn("ocr_status", F.lit("processed"))  # all rows are stored, a third of them comes again
    return M.upsert_flyers(old, f.filter("id % 3 = 0")).select("id", "ocr_status")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'failed' ELSE o_orderstatus END AS ocr_status FROM orders")
def mark_flyers(s, d):
    f = bind.read_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("ocr_status"))
    return M.mark_flyers(f, f.filter("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("ok")))


_NEW = f""", f AS (SELECT o_orderkey AS id, {_NAMES} AS store_name, CASE WHEN o_orderkey % 2 = 0 THEN 'Rua A, 1' END AS address FROM orders WHERE o_custkey % 6 NOT IN (1, 2)),
n AS (SELECT *, regexp_replace(upper(store_name), '[^A-Z0-9 ]', '', 'g') AS normalized_name FROM f QUALIFY row_number() OVER (PARTITION BY regexp_replace(upper(store_name), '[^A-Z0-9 ]', '', 'g') ORDER BY id) = 1),
new AS (SELECT * FROM n WHERE normalized_name NOT IN (SELECT regexp_replace(upper(s_name), '[^A-Z0-9 ]', '', 'g') FROM supplier) AND normalized_name NOT IN (SELECT regexp_replace(upper(c_name), '[^A-Z0-9 ]', '', 'g') FROM customer)) """


@query(_NEW + """SELECT store_name AS name, normalized_name, 3 AS tier, 'pending_review' AS status, CASE WHEN address IS NOT NULL THEN 7.0 ELSE 0.0 END AS address_confidence FROM new""")
def discover_stores(s, d):
    return M.discover_stores(_named_flyers(s, d), bind.stores(s, d), _registry(s, d)).select("name", "normalized_name", "tier", "status", "address_confidence")


_SIMILAR = """, a AS (SELECT s_suppkey AS left_id, n_name AS n, replace(upper(s_name), '#', '') AS own FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT n_nationkey AS right_id, n_name AS n FROM nation) """


@query(_SIMILAR + "SELECT left_id, right_id, 100.0::DOUBLE AS score FROM a JOIN b USING (n)")
def store_similarity_join(s, d):
    st, n = bind.stores(s, d), bind.read_table(s, d, "nation")
    return M.store_similarity_join(st.select("id", F.concat_ws(" ", "name", "city").alias("name")), n.select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")))


@query(_SIMILAR + """SELECT left_id AS id, CASE WHEN left_id % 3 = 0 THEN NULL ELSE right_id END AS matched_store_id, CASE WHEN left_id % 3 = 0 THEN right_id + 1000 END AS matched_registry_id, 100.0::DOUBLE AS match_score
FROM a JOIN b USING (n) WHERE left_id % 7 <> 0 UNION ALL SELECT left_id, NULL, NULL, NULL FROM a WHERE left_id % 7 = 0""")
def registry_match(s, d):
    # a third of the names is only like a registry entry, a seventh like nothing
    k = F.col("id")
    name = F.when(k % 7 == 0, "zz").when(k % 3 == 0, F.concat_ws(" ", F.lit("the"), F.reverse("city"), "name")).otherwise(F.concat_ws(" ", "name", "city"))
    flyers = bind.stores(s, d).select("id", name.alias("store_name"))
    n = bind.read_table(s, d, "nation")
    stores = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    registry = n.select((F.col("n_nationkey") + 1000).alias("id"), F.reverse("n_name").alias("name"))
    return M.registry_match(flyers, stores, registry).select("id", F.col("matched_store_id").cast("long").alias("matched_store_id"), F.col("matched_registry_id").cast("long").alias("matched_registry_id"), "match_score")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN n_name WHEN s_suppkey % 2 = 0 THEN 'declared' ELSE n_name END AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def sync_store_fields(s, d):
    st = bind.stores(s, d)
    declared = st.filter("id % 2 = 0").select(F.upper("name").alias("name"), F.when(F.col("id") % 5 == 0, " ").otherwise("declared").alias("city"), F.array(F.lit("Rua A, Centro, Santos")).alias("units"))
    return M.sync_store_fields(st, declared, ["city"])[0].select("id", "city")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 > 0 THEN 'u' || s_suppkey END AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'x' END AS selector FROM supplier""")
def sync_store_config(s, d):
    st = bind.stores(s, d)
    declared = st.filter("id % 2 = 0").select(F.upper("name").alias("name"), F.lit("declared").alias("city"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("u"), "id")).otherwise(" ").alias("url"), F.lit("x").alias("selector"), F.array(F.lit("Rua A")).alias("units"))
    return M.sync_store_fields(st, declared, ["city"])[0].select("id", F.col("config")["url"].alias("url"), F.col("config")["selector"].alias("selector"))


@query("""SELECT id AS store_id, CASE WHEN id % 2 = 0 THEN CASE tier WHEN 1 THEN 10080 WHEN 4 THEN 43200 ELSE 1440 END ELSE 7 END AS frequency_minutes, CASE WHEN id % 2 = 0 THEN 3 ELSE 1 END AS max_retries FROM stores WHERE id % 2 = 0 OR id % 3 = 0""")
def sync_frequencies(s, d):
    st = bind.stores(s, d)
    old = st.filter("id % 3 = 0").select(F.col("id").alias("store_id"), "tier", F.lit(7).alias("frequency_minutes"), *[F.lit(1).alias(c) for c in ("max_retries", "timeout_seconds", "rate_limit_per_minute")], F.lit(True).alias("enabled"))
    declared = st.filter("id % 2 = 0").select(F.upper("name").alias("name")).withColumn("is_active", F.lit(True)).unionByName(st.filter("id % 2 = 1").select("name", F.lit(False).alias("is_active")))
    return M.sync_frequencies(old, st, declared).select("store_id", "frequency_minutes", "max_retries")


@query("""SELECT id, CASE WHEN id % 4 = 0 AND is_active THEN 'Rua ' || id || ' nova' WHEN id % 4 = 2 AND is_active THEN 'Rua ' || id || ' velha' ELSE 'old' END AS address FROM stores""")
def propagate_addresses(s, d):
    st = bind.stores(s, d).withColumn("address", F.lit("old"))
    at = lambda day: F.lit(f"2026-01-0{day}").cast("timestamp")
    f = st.filter("is_active").select("id", F.lower("name").alias("store_name"))
    row = lambda d_, word, confidence, day: d_.select("store_name", F.concat(F.lit("Rua "), "id", F.lit(word)).alias("address"), F.lit(confidence).alias("confidence"), at(day).alias("at"))
    found = row(f.filter("id % 4 = 0"), " nova", 7.0, 2).unionByName(row(f.filter("id % 2 = 0"), " velha", 9.0, 1)).unionByName(row(f, " unsure", 6.9, 3))
    return M.propagate_addresses(st, found).select("id", "address")


@query("""SELECT upper(s_name) AS name, 'Rua A' AS neighborhood, 'Santos' AS city FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT upper(s_name), 'Rua B', 'Santos' FROM supplier WHERE s_suppkey % 2 = 0""")
def sync_store_units(s, d):
    declared = bind.stores(s, d).filter("id % 2 = 0").select(F.upper("name").alias("name"), "city", F.array(F.lit("Rua A, Centro, Santos"), F.lit("Rua B,Santos")).alias("units"))
    return M.sync_store_fields(bind.stores(s, d), declared, ["city"])[1].select("name", "neighborhood", "city")
