"""Goldens of rules: product JSON, flyer names and blocks, imports, registry and catalog sync."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feira.operators import extract as X
from feira.operators import maintain as M
from feira.sources import files


def ld(*items, kind="ItemList"):
    return '<script type="application/ld+json">' + json.dumps({"@type": kind, "itemListElement": [{"item": i} if i is not None else {"name": "no item"} for i in items]}) + "</script>"


def test_jsonld(spark):
    one = lambda name, **offers: {"name": name, "offers": offers}
    pages = [
        (1, ld(one("Lançamento\n\n", price=5), one(" LANÇAMENTO ", price=5), one("Lançamento da casa 500g", price=6), one("Kit {{2}}", price=7.5))),
        (2, ld(one("Low", lowPrice=4, price=9), one("Zero low", lowPrice=0, price=7), one("Empty low", lowPrice="", price=7), one("None", lowPrice=None), one("Neg", price=-1))),
        (3, ld(one("Before", price=1), one("Text", price="12.90"), one("After", price=2)) + ld(one("Next block", price=3))),
        (4, ld(one("", price=1), None, one("Listed", price=1) | {"offers": [{"price": 1}]}, one("Gone", price=1))),
        (5, ld(one("Wrong type", price=1), kind="Product") + '<script type="application/ld+json">{broken</script>' + "<script type='text/javascript'>x</script>"),
        (6, None), (7, ""), (8, '<script type="application/ld+json">[1, 2]</script>' + ld(one("Último 2kg", price=10)).replace("script type", "SCRIPT  type")),
    ]
    got = sorted((r["id"], r["name"], r["price"], r["unit"]) for r in X.jsonld_products(spark.createDataFrame(pages, "id int, html string")).collect())
    assert got == [(1, "Kit {{2}}", 7.5, ""), (1, "Lançamento da casa 500g", 6.0, "500g"), (2, "Empty low", 7.0, ""), (2, "Low", 4.0, ""), (2, "Zero low", 7.0, ""),
                   (3, "Before", 1.0, ""), (3, "Next block", 3.0, ""), (8, "Último 2kg", 10.0, "2kg")]


def test_shopify(spark):
    def answer(*products):
        return json.dumps({"products": products})

    v = lambda price, **more: {"title": f"v{price}", "price": price} | more
    rows = [(1, answer({"title": " Coco 1kg \n", "vendor": " S ", "variants": [v("9.00", available=False), v("8.00"), v("7.00", available=True)]})),
            (2, answer({"title": "  \n", "variants": [v("9.00")]}, {"title": "Number", "variants": [v(6.5, available=True)]}, {"title": "None free", "variants": [v("5", available=False), v("4", available=None)]})),
            (3, answer({"title": "Bad", "variants": [v("abc")]}, {"title": "Free", "variants": [v("0")]}, {"title": "No variants", "variants": []}, {"title": "Absent"}, {"variants": [v("1")]})),
            (4, None), (5, "{broken")]
    got = sorted(tuple(r) for r in X.shopify_products(spark.createDataFrame(rows, "id int, json string")).collect())
    assert got == [(1, "Coco 1kg", "S", 8.0, "v8.00", "1kg"), (2, "None free", "", 5.0, "v5", ""), (2, "Number", "", 6.5, "v6.5", "")]


def test_vtex(spark):
    def seller(price, n, **more):
        return {"sellerName": "s", "commertialOffer": {"Price": price, "AvailableQuantity": n} | more}

    answer = json.dumps([{"productName": "Leite", "brand": "declared", "items": [
        {"nameComplete": "Coco Ralado Sococo 1kg", "name": "Coco R", "sellers": [seller(9.9, 3, priceValidUntil="2026-05-01"), seller(8, 0), seller(None, 3), seller("7", 3)]},
        {"nameComplete": "", "name": "Flocos", "sellers": [seller(5, 1)]}, {"sellers": [seller(4, 1), {"sellerName": "x"}, seller(-1, 1)]}, {"name": "No seller"}]}])
    rows = spark.createDataFrame([(1, answer, "coco"), (2, None, "coco"), (3, "[]", None)], "id int, json string, ingredient string")
    catalog = spark.createDataFrame([("coco", ["Sococo", "Ducoco"])], "canonical_name string, brands array<string>")
    got = sorted((r["name"], r["brand"], r["unit"], r["validity_raw"], r["price"], r["quantity"]) for r in X.vtex_offers(rows, catalog).collect())
    assert got == [("Coco Ralado Sococo 1kg", "Sococo", "1kg", "2026-05-01", 9.9, 3), ("Flocos", "declared", "", "", 5.0, 1), ("Leite", "declared", "", "", 4.0, 1)]
    assert {r["brand"] for r in X.vtex_offers(rows).collect()} == {"declared"}


@pytest.mark.parametrize(("text", "name"), [("LEITE", True), ("Arroz Tipo 1", True), ("sai por", False), ("unidade", False), ("o kg", False), ("abc", False), ("ab 12345 cd", False), ("Preço especial", False),
                                            ("pacote 5kg", False), ("Café torrado", True), ("ofertas da semana", False), ("  ", False), (None, None)])
def test_is_product_name(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(X.is_product_name(F.col("t"))).first()[0] is name


def test_price_blocks(spark):
    box = lambda x, y, h: [[x - 10.0, y - h / 2], [x + 10.0, y - h / 2], [x + 10.0, y + h / 2], [x - 10.0, y + h / 2]]
    rows = [("f", "12", box(100.0, 300.0, 80.0)), ("f", "90", box(150.0, 290.0, 40.0)), ("f", "LEITE INTEGRAL", box(100.0, 200.0, 20.0)), ("f", "sai por", box(100.0, 220.0, 20.0)), ("f", "unidade", box(100.0, 230.0, 20.0)),
            ("f", "Piracanjuba", box(110.0, 180.0, 20.0)), ("f", "too far above", box(100.0, -400.0, 20.0)), ("g", "no price here", box(1.0, 1.0, 20.0))]
    r = spark.createDataFrame(rows, "flyer_id string, text string, box array<array<double>>")
    for adapt in (True, False):
        assert [tuple(x) for x in X.price_blocks(r, adapt).collect()] == [("f", 12.9, ["Piracanjuba", "LEITE INTEGRAL"])]


def test_clustering_params(spark):
    # columns, row gap, density, text height -> gap, x_gap, block_dx, above, most
    cases = {(2, 150.0, 50.0, 20.0): (80.0, 250.0, 260.0, 375.0, 6), (8, 60.0, 150.0, 10.0): (26.88, 120.0, 300.0, 200.0, 4), (1, 0.0, 10.0, 40.0): (78.0, 300.0, 260.0, 320.0, 8), (5, 20.0, 50.0, 31.0): (36.0, 240.0, 300.0, 200.0, 6)}
    d = spark.createDataFrame([(str(k), *c) for k, c in enumerate(cases)], "flyer_id string, columns int, row_gap double, density double, text_height double")
    got = {(r["columns"], r["row_gap"], r["density"], r["text_height"]): (round(r["gap"], 4), round(r["x_gap"], 4), r["block_dx"], r["above"], r["most"]) for r in X.clustering_params(d).collect()}
    assert got == cases


def test_import_rows(spark, tmp_path):
    head = "ingredient,store,price,unit,collected_at,brand\n"
    lines = [f"{'Leite' if k % 7 else 'Nada'},Loja,{5 if k % 5 else 'x'},1kg,2026-03-01,X" for k in range(400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(head + "\n".join(lines) + "\n")
    (tmp_path / "in" / "b.csv").write_text(head + "Nada,Loja,5,1kg,2026-03-01,X\n")
    ing, st = spark.createDataFrame([("Leite",)], "canonical_name string"), spark.createDataFrame([("1", "Loja")], "id string, name string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")  # a file in many blocks
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        good, bad = files.import_manual_prices(spark, str(tmp_path / "in"), ing, st)
        assert sorted(r["row"] for r in bad.collect()) == sorted([2] + [k + 2 for k in range(400) if k % 7 == 0 or k % 5 == 0])
        assert good.count() == sum(k % 7 > 0 and k % 5 > 0 for k in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_registry_units_and_sync(spark):
    registry = spark.createDataFrame([(1, "A", "approved", 7, " Rua 1 ", ""), (2, "B", "approved", None, "Rua 2", "1"), (3, "C", "pending_review", None, "Rua 3", "")], "id int, name string, status string, matched_store_id int, address string, phone string")
    stores = spark.createDataFrame([(7, "Store", "old", "9")], "id int, name string, address string, phone string")
    units = spark.createDataFrame([("reg-2", "Rua 2", "visit", False), ("8", "Rua 8", "visit", True)], "store_id string, address string, source string, is_active boolean")
    done, merged, after = M.registry_merge(registry, stores, units)
    assert sorted((r["store_id"], r["address"], r["source"], r["is_active"]) for r in after.collect()) == [("7", " Rua 1 ", "registry", True), ("8", "Rua 8", "visit", True), ("reg-2", "Rua 2", "registry", True)]
    st = spark.createDataFrame([(1, "Loja", 1, {"k": "old"}), (2, "Outra", 4, {"k": "old"}), (3, "Mais", 2, None)], "id int, name string, tier int, config map<string,string>")
    declared = spark.createDataFrame([("LOJA", "u", "", ["Rua A, Centro, Santos"], True), ("outra", " ", None, [], False), ("new", "x", "y", [], True)], "name string, url string, selector string, units array<string>, is_active boolean")
    got = {r["id"]: r["config"] for r in M.sync_store_fields(st, declared.drop("is_active"), [])[0].collect()}
    assert got == {1: {"url": "u"}, 2: {"k": "old"}, 3: None}
    none = spark.createDataFrame([], "store_id int, tier int, frequency_minutes int, max_retries int, timeout_seconds int, rate_limit_per_minute int, enabled boolean")
    assert [tuple(r) for r in M.sync_frequencies(none, st, declared).collect()] == [(1, 1, 10080, 3, 120, 10, True)]


def test_merge_terms_changes(spark):
    schema = "canonical_name string, exclude_terms array<string>, search_terms array<string>, brands array<string>, aliases array<string>"
    stored = spark.createDataFrame([("a", ["x"], ["s"], ["B"], ["ok", "no1", "l" * 61]), ("b", None, None, ["B"], None), ("c", ["x"], ["s"], [], ["ok"])], schema)
    declared = spark.createDataFrame([("a", ["y"], ["t"], ["B"], None), ("b", None, ["t"], None, None)], schema)
    got = {r["canonical_name"]: (r["changed"], [tuple(x) for x in r["changes"]]) for r in M.merge_terms(stored, declared).collect()}
    assert got["a"] == (True, [("search_terms", ["t"], []), ("exclude_terms", ["y"], ["x"]), ("aliases", [], ["l" * 61, "no1"])])
    assert got["b"] == (True, [("search_terms", ["t"], [])]) and got["c"] == (False, [])
