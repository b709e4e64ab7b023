"""Operators on small tables with known answers."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from feira.operators import analytics as A
from feira.operators import anomaly as N
from feira.operators import basket as B
from feira.operators import extract as X
from feira.operators import maintain as M
from feira.operators import match as H
from feira.operators import monitor as O
from feira.operators import prices as P

PRICE = "id string, ingredient_id string, store_id long, store_name string, price_per_kg double, collected_at timestamp, valid_from date, valid_until date, is_promotion boolean, tier int, confidence double"


def prices(spark, rows):
    """rows: (ingredient, store, ppk, day of March 2026)."""
    day = lambda d: dt.date(2026, 3, d)
    return spark.createDataFrame([(str(k), i, s, f"S{s}", p, dt.datetime(2026, 3, d), day(d), day(min(d + 7, 31)), False, 1, 1.0) for k, (i, s, p, d) in enumerate(rows)], PRICE)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_winners_and_trends(spark):
    p = prices(spark, [("a", 1, 10.0, 1), ("a", 2, 12.0, 1), ("a", 1, 15.0, 2), ("a", 2, 14.0, 2), ("a", 3, 0.0, 2)])
    assert rows(A.longitudinal_winners(p), "store_id", "wins") == [(1, 1), (2, 1)]
    t = A.price_trends(p, "a").orderBy("day").first()
    assert (t["avg_ppk"], t["min_ppk"], t["max_ppk"], t["store_count"]) == (11.0, 10.0, 12.0, 2)


def test_ranking_counts_rows_not_stores(spark):
    p = prices(spark, [("a", 1, 1.0, 1), ("a", 1, 2.0, 2), ("a", 1, 3.0, 3), ("a", 2, 4.0, 1), ("b", 2, 1.0, 1), ("b", 1, 2.0, 1)])
    assert rows(A.cross_ingredient_ranking(p), "store_id", "top1_count", "top3_count", "total_ingredients") == [(1, 1, 2, 2), (2, 1, 1, 2)]


def test_latest_prices_has_one_row_a_key(spark):
    p = prices(spark, [("a", 1, 10.0, 1), ("a", 1, 11.0, 3), ("a", 1, 0.0, 4), ("a", 2, 9.0, 1)])
    got = P.latest_prices(p, F.lit(dt.date(2026, 3, 5)))
    assert rows(got, "store_id", "price_per_kg") == [(1, 11.0), (2, 9.0)]
    assert P.latest_prices(p.filter("false"), F.lit(dt.date(2026, 3, 5))).count() == 0


def test_null_order(spark):
    p = prices(spark, [("a", 1, None, 1), ("a", 2, 5.0, 1)])
    day = F.lit(dt.date(2026, 3, 2))
    assert [r["store_id"] for r in P.search_prices(p, day, "a").collect()] == [2, 1]
    assert [r["store_id"] for r in P.search_prices(p, day, "a", descending=True).collect()] == [1, 2]


def test_basket(spark):
    p = prices(spark, [("x", 1, 20.0, 1), ("y", 1, 29.875, 1), ("x", 2, 25.0, 1), ("y", 2, 19.875, 1), ("z", 3, 1.0, 1)])
    b = spark.createDataFrame([(1, "x", 5.0), (1, "y", 2.0), (2, "x", 1.0), (2, "none", 1.0)], "basket_id long, ingredient_id string, qty_kg double")
    got = {r["basket_id"]: r for r in B.optimize_basket(b, p).collect()}
    assert (got[1]["mono_total"], got[1]["multi_total"], got[1]["saving"], got[1]["multi_stores"]) == (159.75, 139.75, 20.0, [1, 2])
    assert got[2]["missing"] == 1 and got[2]["mono_total"] is None and got[2]["multi_total"] is None
    assert rows(B.pair_stores(b, p), "basket_id", "a", "b", "total") == [(1, 1, 2, 139.75)]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_basket_against_brute_force(spark, monkeypatch, limit):
    import itertools
    import random

    monkeypatch.setattr(B, "MAX_BROADCAST_PRICES", limit)
    r = random.Random(5)
    cells = {(i, s): r.randint(100, 999) / 100 for i in "abcd" for s in range(7) if r.random() < 0.6}
    p = prices(spark, [(i, s, v, 1) for (i, s), v in cells.items()])
    want = {k: {i: float(r.randint(1, 5)) for i in r.sample("abcd", r.randint(1, 4))} for k in range(20)}
    b = spark.createDataFrame([(k, i, q) for k, w in want.items() for i, q in w.items()], "basket_id long, ingredient_id string, qty_kg double")
    for row in B.optimize_basket(b, p).collect():
        w = want[row["basket_id"]]
        sets = [c for n in (1, 2) for c in itertools.combinations(range(7), n)]
        total = lambda c: sum(q * min((cells.get((i, s), float("inf")) for s in c)) for i, q in w.items())
        best, mono = min(map(total, sets)), min(total((s,)) for s in range(7))
        assert (row["multi_total"] or float("inf")) == pytest.approx(best) and (row["mono_total"] or float("inf")) == pytest.approx(mono)


def test_best_sets_by_parts_and_by_sets(monkeypatch):
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 4, 6):
        cost = np.where(r.random((n, 9)) < 0.7, r.random((n, 9)), B.LACKING)
        want = [min(cost[:, list(c)].min(1).sum() for k in range(1, most + 1) for c in itertools.combinations(range(9), k)) for most in (1, 2, 3)]
        for limit in (12, 0):
            monkeypatch.setattr(B, "SPLIT_ITEMS", limit)
            got = B._best_sets(cost, 3)
            assert [t for t, _ in got] == pytest.approx(want)
            for total, stores in got:
                assert cost[:, stores].min(1).sum() == pytest.approx(total)


def test_anomaly(spark):
    p = prices(spark, [("a", 1, 10.0, d) for d in range(1, 8)] + [("a", 1, 11.0, 8), ("a", 1, 30.0, 9), ("b", 1, 5.0, 1)])
    stats = N.historical_stats(p, F.lit(dt.date(2026, 3, 10)))
    tags = {(r["ingredient_id"], r["price_per_kg"]): (r["tag"], r["is_anomaly"]) for r in N.detect_anomaly(p, stats).collect()}
    assert tags["a", 30.0] == ("PRECO_ELEVADO", True) and tags["a", 10.0][0] == "NORMAL" and tags["b", 5.0] == ("SEM_HISTORICO", False)
    e = N.enrichment_summary(N.enrich_prices(p, stats)).first()
    assert (e["total"], e["anomalies"]) == (10, 1)
    assert [r["price_per_kg"] for r in N.detect_price_outliers(p, F.lit(dt.date(2026, 3, 10))).collect()] == [30.0]


def test_isolation_score_ranks_the_outlier_first(spark):
    p = prices(spark, [("a", 1, 10.0 + d / 10, d) for d in range(1, 20)] + [("a", 1, 90.0, 25), ("b", 1, 1.0, 1)])
    s = N.isolation_score(p).orderBy(F.desc("score")).collect()
    assert len(s) == 20 and s[0]["id"] == "19" and s[0]["score"] > 0.6


def logs(spark, spec):
    return spark.createDataFrame([(k, s, st, dt.datetime(2026, 3, d), n, float(d)) for k, (s, st, d, n) in enumerate(spec)], "id long, store_name string, status string, started_at timestamp, items_found long, latency_ms double")


def test_streaks(spark):
    x = logs(spark, [("a", "error", 3, 0), ("a", "failed", 2, 0), ("a", "error", 1, 0), ("b", "error", 3, 0), ("b", "completed", 2, 5), ("c", "completed", 1, 0), ("c", "completed", 2, 0), ("c", "completed", 3, 0), ("d", "error", 1, 0)])
    assert rows(O.failure_streak(x), "store_name", "streak") == [("a", 3), ("b", 1), ("c", 0), ("d", 1)]
    assert rows(O.auto_disable(x), "store_name") == [("a",)] and rows(O.zero_product_streak(x), "store_name") == [("c",)]


def test_exclusive_p95(spark):
    import statistics

    v = [float(i * i % 37) for i in range(40)]
    df = spark.createDataFrame([(v,), (v[:5],), ([],)], "v array<double>").select(O.exclusive_p95(F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == pytest.approx([statistics.quantiles(v, n=20)[18], max(v[:5]), 0.0])


def test_heal(spark):
    st = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "name string, is_active boolean")
    x = logs(spark, [("a", "completed", 28, 5), ("b", "error", 28, 0)])
    ev = spark.createDataFrame([("a", "auto_disabled", dt.datetime(2026, 1, 1)), ("b", "auto_disabled", dt.datetime(2026, 3, 29))], "scraper_name string, event_type string, created_at timestamp")
    assert rows(O.heal_candidates(st, x, ev, F.lit(dt.datetime(2026, 3, 30))), "store_name", "decision") == [("a", "reactivated"), ("b", "skipped"), ("d", "missing_facts")]


def test_upsert_is_idempotent(spark):
    old = prices(spark, [("a", 1, 10.0, 1), ("b", 1, 5.0, 1)]).withColumn("raw_price", F.col("price_per_kg"))
    new = prices(spark, [("a", 1, 8.0, 1), ("a", 1, 9.0, 1), (None, 1, 1.0, 1)]).withColumn("raw_price", F.col("price_per_kg"))
    first, counts = M.upsert_prices(old, new)
    assert rows(first, "ingredient_id", "price_per_kg") == [("a", 8.0), ("b", 5.0)]
    assert counts.first().asDict() == {"total": 3, "failed": 1, "inserted": 1}
    assert rows(M.upsert_prices(first, new)[0], "ingredient_id", "price_per_kg") == [("a", 8.0), ("b", 5.0)]


CATALOG = "canonical_name string, brands array<string>, aliases array<string>, search_terms array<string>, exclude_terms array<string>"


def test_match_brand_and_route(spark):
    cat = spark.createDataFrame([("Chocolate em Pó", ["Nestlé"], ["cacau em po"], [], ["cremoso"]), ("Creme de Leite", ["Piracanjuba"], [], ["cl"], []), ("Leite Condensado", ["Moça", "Itambé"], ["leite moca"], [], []),
                                 ("Manteiga", ["Aviação"], [], [], [])], CATALOG)
    texts = ["Leite Condensado Moça 395g", "Manteiga Aviação 200g", "Chocolate CLassic 100g", "Papel Amarelo Manteiga", "Chocolate em Pó Cremoso", "Sabão em barra"]
    p = spark.createDataFrame(list(enumerate(texts)), "id long, raw_product string")
    m = {r["raw_product"]: (r["ingredient"], r["match_type"]) for r in H.match_ingredient(p, cat).collect()}
    assert m[texts[0]] == ("Leite Condensado", "exato") and m[texts[1]] == ("Manteiga", "exato")
    # a colour phrase is no exact hit, but a word in a short text is a full fuzzy one
    assert m[texts[2]][0] is None and m[texts[3]] == ("Manteiga", "proximo_nome") and m[texts[4]][0] != "Chocolate em Pó" and m[texts[5]][0] is None
    gated = H.keyword_gate(p, cat)
    assert {r["id"] for r in gated.collect()} == {0, 1, 2, 3, 4}
    b = H.extract_brand(p.filter("id < 2").withColumn("ingredient", F.when(F.col("id") == 0, "Leite Condensado").otherwise("Manteiga")), cat)
    assert rows(b, "id", "brand") == [(0, "Moça"), (1, "Aviação")]
    routed = H.route_match(spark.createDataFrame([(1, "x", 100.0, 0.0), (2, "x", 75.0, 0.0), (3, "x", 75.0, 0.95), (4, None, 50.0, 0.0)], "id long, ingredient string, score double, semantic double"))
    assert rows(routed, "id", "route") == [(1, "accept"), (2, "review"), (3, "accept"), (4, "drop")]
    top = {r["id"]: r["top"] for r in H.rank_ingredients(p, cat).collect()}
    assert top[0][0]["canonical_name"] == "Leite Condensado" and len(top[0]) == 3


def test_flyer_lines(spark):
    text = "Válido até 10/10\nLeite Condensado\nMoça 395g\nR$ 5,99\nsomente hoje\nArroz 5kg 24,90\nab\nxy 1,00"
    got = X.parse_flyer_lines(X.flyer_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"))).orderBy("pos").collect()
    assert [(r["product"], r["price"], r["validity_raw"]) for r in got][0] == ("Leite Condensado Moça 395g", 5.99, "Válido até 10/10") or got[0]["price"] == 395.0
    assert all(r["id"] == 1 for r in got)


def test_product_json(spark):
    html = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"item":{"name":"Leite","offers":{"lowPrice":4.5}}},{"item":{"name":"Lançamento","offers":{"price":1}}}]}</script>'
    assert rows(X.jsonld_products(spark.createDataFrame([(1, html), (2, "<p>")], "id long, html string")), "name", "price") == [("Leite", 4.5)]
    shop = '{"products":[{"title":"Cacau","variants":[{"title":"a","price":"9.9","available":false},{"title":"b","price":"8.5","available":true}]},{"title":"Zero","variants":[{"title":"a","price":"0"}]}]}'
    assert rows(X.shopify_products(spark.createDataFrame([(1, shop)], "id long, json string")), "name", "price") == [("Cacau", 8.5)]
    vtex = '[{"productName":"Coco","brand":"B","items":[{"name":"1kg","sellers":[{"sellerName":"s","commertialOffer":{"Price":7.0,"AvailableQuantity":3}},{"sellerName":"t","commertialOffer":{"Price":7.0,"AvailableQuantity":0}}]}]}]'
    assert rows(X.vtex_offers(spark.createDataFrame([(1, vtex)], "id long, json string")), "name", "seller") == [("1kg", "s")]


def test_addresses(spark):
    df = spark.createDataFrame([(1, "Rua das Flores, 123 Centro\nTel: (13) 3222-1234"), (2, "nada"), (3, "Fone 13 99999-1234 Bairro")], "id long, text string")
    got = {r["id"]: r for r in X.best_address(X.extract_addresses(df)).collect()}
    assert got[1]["kind"] == "rua_com_numero" and got[1]["confidence"] == 10.0 and got[2]["address"] is None and got[3]["kind"] == "combinado"


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def test_region_prices(spark):
    r = [("f", "3590", box(0.0, 0.0, 80.0, 70.0), 1.0), ("f", "19", box(500.0, 0.0, 60.0, 80.0), 1.0), ("f", "90", box(570.0, 0.0, 30.0, 30.0), 1.0), ("f", "Arroz Branco", box(0.0, -60.0, 80.0, 20.0), 1.0), ("g", "280", box(0.0, 0.0, 60.0, 70.0), 1.0), ("g", "12,50", box(10.0, 90.0, 60.0, 30.0), 1.0)]
    df = spark.createDataFrame(r, "flyer_id string, text string, box array<array<double>>, score double")
    assert rows(X.region_prices(df), "flyer_id", "price") == [("f", 19.9), ("f", 35.9), ("g", 2.8), ("g", 12.5)]
    assert rows(X.dual_price_dedup(df), "flyer_id", "price") == [("f", 19.9), ("f", 35.9), ("g", 2.8)]
    assert [tuple(b["texts"]) for b in X.price_blocks(df).collect()] == [("Arroz Branco",)]
    assert {b["flyer_id"] for b in X.layout_profile(df).collect()} == {"f", "g"}


def test_registry_flow(spark):
    flyers = spark.createDataFrame([(1, "Atacado Sol", "Rua A, 1"), (2, "ATACADO SOL", None), (3, "Drogaria X", None), (4, "Mercado Lua", None)], "id long, store_name string, address string")
    stores = spark.createDataFrame([("s1", "Mercado Lua")], "id string, name string")
    reg = spark.createDataFrame([], "id long, name string, normalized_name string, status string, matched_store_id string, match_score double, address string, address_confidence double")
    new = M.discover_stores(flyers, stores, reg)
    assert rows(new, "name", "address_confidence") == [("Atacado Sol", 7.0)]
    r2 = spark.createDataFrame([(1, "A", "pending_review", 3), (2, "B", "pending_review", 1)], "id long, name string, status string, n int")
    c = r2.select("id", F.col("n").alias("products"))
    assert rows(M.auto_promote(r2, c), "id", "status") == [(1, "approved"), (2, "pending_review")]


def test_review_flow(spark):
    q = spark.createDataFrame([(1, "S", "Leite X", 0.9, "pending"), (2, "S", "Sabão", 0.5, "pending")], "id long, store_name string, raw_product string, confidence double, status string")
    ing = spark.createDataFrame([("Leite",)], "canonical_name string")
    st = spark.createDataFrame([(7, "S")], "id long, name string")
    p, a, q2 = M.review_approve(q, spark.createDataFrame([(1, "Leite"), (2, "?")], "id long, ingredient string"), ing, st)
    assert rows(p, "ingredient_id", "store_id", "tier") == [("Leite", "7", 2)] and rows(a, "alias") == [("Leite X",)] and rows(q2, "id", "status") == [(1, "approved"), (2, "pending")]
    again = spark.createDataFrame([(3, "S", "Sabão", 0.1, "pending"), (4, "S", "Novo", 0.1, "pending"), (5, "S", "Novo", 0.1, "pending")], q.schema)
    assert rows(M.review_insert(q, again), "id") == [(1,), (2,), (4,)]


def _every_pair(items, offers, keep):
    """The cheapest pairs of the stores that have an item, by comparing all."""
    price = {(i, s): p for i, s, p in offers}
    stores = sorted({s for i, s, _ in offers if i in items})
    out = []
    for k, a in enumerate(stores):
        for b in stores[k + 1:]:
            costs = [min(q * price.get((i, s), 1e15) for s in (a, b)) for i, q in sorted(items.items())]
            if max(costs) < 1e15:
                out.append((sum(costs), a, b))
    return sorted(out)[:keep]


@pytest.mark.parametrize("limit,small", [(500_000, 0), (0, 0), (0, 1 << 19)])
def test_pairs_of_many_stores(spark, monkeypatch, limit, small):
    """By thresholds and whole, with prices broadcast and joined; item 0 is in one store
    only, which must not pair with a store that has nothing of the basket."""
    monkeypatch.setattr(B, "MAX_BROADCAST_PRICES", limit)
    monkeypatch.setattr(B, "SMALL", small)
    rng = random.Random(7)
    offers = [("i0", 500, 3.0)] + [(f"i{i}", s, float(rng.randint(1, 40))) for i in range(1, 9) for s in range(300) if rng.random() < 0.7]
    baskets = {b: {f"i{i}": float(rng.randint(1, 4)) for i in rng.sample(range(1, 9), 1 + b % 6)} for b in range(12)} | {99: {"i0": 1.0}}
    b = spark.createDataFrame([(k, i, q) for k, own in baskets.items() for i, q in own.items()], "basket_id long, ingredient_id string, qty_kg double")
    p = spark.createDataFrame(offers, "ingredient_id string, store_id long, price_per_kg double")
    got = {}
    for r in B.pair_stores(b, p, keep=4).collect():
        got.setdefault(r["basket_id"], []).append((r["total"], r["a"], r["b"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, own in baskets.items() if (w := _every_pair(own, offers, 4))}
    price = {(i, s): x for i, s, x in offers}
    for r in B.optimize_basket(b, p).collect():
        own = baskets[r["basket_id"]]
        mono = min((sum(q * price.get((i, s), 1e15) for i, q in own.items()), s) for s in {s for _, s, _ in offers})
        best = min([x for x, _, _ in _every_pair(own, offers, 1)] + [mono[0]])
        assert (r["mono_total"], r["mono_store"]) == (mono if mono[0] < 1e15 else (None, None))
        assert r["multi_total"] == (best if best < 1e15 else None)


def test_layout_reads_regions_once(spark):
    """One shuffle of slim rows; text without a digit counts, and a flyer may span Arrow batches."""
    box = lambda x, y, h: [[x - 20.0, y - h / 2], [x + 20.0, y - h / 2], [x + 20.0, y + h / 2], [x - 20.0, y + h / 2]]
    own = [("f", t, box(400.0 * k, y, h), 0.9) for k in range(1, 301) for t, y, h in (("12", 100.0, 80.0), ("5", 200.0, 70.0), ("name", 60.0, 20.0))]
    d = spark.createDataFrame(own + [("g", "only text", box(1.0, 1.0, 30.0), 0.9)], "flyer_id string, text string, box array<array<double>>, score double")
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        p = X.layout_profile(d)
        assert p._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
        assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()
        assert rows(p, "flyer_id", "region_count", "text_height", "price_count", "columns", "col_gap", "row_gap") == [("f", 900, 70.0, 300, 300, 400.0, 150.0), ("g", 1, 30.0, 0, 0, 0.0, 0.0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["dual_price_dedup", "clustering_params", "region_prices", "layout_profile"])
def test_dealt_flyers_stay(spark, name):
    """Line items move once, by flyer; the regions made of them don't move again."""
    from feira.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_newest_prices_moves_no_texts(spark):
    from feira.queries import QUERIES

    plan = QUERIES["newest_prices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    folds = [line for line in plan.splitlines() if "Aggregate [" in line and "max_by" in line]
    assert folds and not any("raw_product" in line for line in folds)


def test_jsonld_parts_once(spark):
    """The low price of an item is taken out of its JSON once in the plan, not for each use."""
    d = spark.createDataFrame([(1, "")], "id long, html string")
    project = [x for x in X.jsonld_products(d)._jdf.queryExecution().analyzed().toString().splitlines() if "lowPrice" in x]
    assert sum(x.count("$.offers.lowPrice") for x in project) == 1
