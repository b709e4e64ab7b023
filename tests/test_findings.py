"""What reviews of the repository found."""

from __future__ import annotations

import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from feira.operators import basket as B
from feira.operators import extract as X
from feira.operators import match as H
from feira.operators import names as N
from feira.operators import maintain as M
from feira.plans import collection, price_store
from feira.queries import ORACLE_SQL, QUERIES
from feira.sources import versions

from test_operators import _every_pair
from test_oracles import DATA, TABLES, norm
from test_versions import ids, row
from test_versions import prices as stored


def agrees(spark, name: str, folder, **tables) -> list:
    """The rows of a query over tables of our own (others: the driver's), which must be those of its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        if t not in tables:
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, rel = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted("|".join(norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    return got


def test_words_of_flyer_lines_end_as_in_the_sql(spark, tmp_path):
    # of a number of more than three digits the last three are the price
    texts = spark.createDataFrame([(1, "Leite 7567 unèleontre"), (2, "Arroz 5123 kg\n12é 450"), (3, "Feijão 9456 uns 3789 un")], "doc_id long, text string")
    got = agrees(spark, "parse_flyer_lines", tmp_path, documents=texts)
    assert len(got) == 3 and "7 un|" in got[0]
    own = X.parse_flyer_lines(X.distinct_lines(texts.withColumnRenamed("doc_id", "id"))).collect()  # the source's words have accents
    assert {r["id"]: (r["price"], r["unit"]) for r in own} == {1: (567.0, ""), 2: (123.0, "5 kg"), 3: (456.0, "3 un")}


def counted(spark, rows: list[tuple], schema: str):
    """Rows, and how many of them were read, all times together."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), seen


CATALOG = "canonical_name string, aliases array<string>, search_terms array<string>, exclude_terms array<string>"


def test_matching_reads_products_for_their_texts_and_for_the_result(spark):
    catalog = spark.createDataFrame([("Leite Condensado", [], [], []), ("Creme de Leite", [], [], ["soja"])], CATALOG)
    asked = [("1", "Leite Condensado Moça 395g"), ("2", "Creme Leyte 200g"), ("3", "Leite Condensado Moça 395g"), ("4", None), ("5", "Creme de Leite de Soja")]
    products, seen = counted(spark, asked, "id string, raw_product string")
    got = {r["id"]: (r["ingredient"], r["match_type"]) for r in H.match_ingredient(products, catalog, 60.0).collect()}
    assert got["1"] == got["3"] == ("Leite Condensado", "exato") and got["2"] == ("Creme de Leite", "proximo_nome") and got["4"] == (None, "none") and got["5"][1] != "exato"
    assert seen.value == 2 * len(asked)


def test_a_collection_run_reads_products_for_their_texts_and_for_the_result(spark):
    catalog = spark.createDataFrame([("Leite Condensado", [], [], []), ("Creme de Leite", [], [], [])], CATALOG)
    stores = spark.createDataFrame([(1, "A", 2, "Santos", "delivery", "site")], "id long, name string, tier int, city string, logistics string, type string")
    asked = [(str(k), text, 10.0, "1kg", "A") for k, text in enumerate(("Leite Condensado 395g", "Creme de Azul", "Creme de Azul", None, "Parafuso"))]
    meant = spark.createDataFrame([("Creme de Azul", "Creme de Leite", 0.9)], "raw_product string, ingredient string, semantic double")
    now = F.lit("2026-01-05 10:00:00").cast("timestamp")
    for part, want in ((0, ["Leite Condensado 395g"]), (1, ["Creme de Azul"] * 2)):
        products, seen = counted(spark, asked, "id string, raw_product string, raw_price double, raw_unit string, store_name string")
        got = collection.collection_run(products, catalog, stores, now, semantics=meant)[part].collect()
        assert [r["raw_product"] for r in got] == want and seen.value == 2 * len(asked)
    assert all(r["suggestions"] == ["Creme de Leite"] and "Candidato: 'Creme de Leite'" in r["match_reason"] for r in got)


def test_prices_of_offers_are_worked_out_once(spark):
    shop = spark.createDataFrame([(1, '{"products": [{"title": "Cacau 1kg", "variants": [{"title": "a", "price": "8.5"}]}, {"title": " ", "variants": [{"price": "1"}]}]}')], "id long, json string").repartition(1)
    vtex = spark.createDataFrame([(1, '[{"productName": 0, "items": [{"name": "0", "sellers": [{"sellerName": "s", "commertialOffer": {"Price": 2.5, "AvailableQuantity": 1}}, {"commertialOffer": {"Price": "2", "AvailableQuantity": 1}}]}]}]')], "id long, json string").repartition(1)
    for df, want, path in ((X.shopify_products(shop), [("Cacau 1kg", 8.5)], "$.price,"), (X.vtex_offers(vtex), [("0", 2.5)], "Price,")):
        assert [(r["name"], r["price"]) for r in df.collect()] == want
        assert df._jdf.queryExecution().optimizedPlan().toString().count(path) == 1, df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_names_are_not_broadcast_for_the_size_of_their_names(spark, tmp_path):
    words = [f"{x}{k:06d}" for k in range(300) for x in ("supplier", "nation", "market")]
    rows = [(" ".join(words[k:k + 3]),) for k in range(0, len(words), 3)]
    sides = []
    for c, own in (("a", rows), ("b", rows[::2])):
        N.prepared(spark.createDataFrame(own, "name string"), 70.0).coalesce(1).write.parquet(f"{tmp_path}/{c}")
        sides.append(spark.read.parquet(f"{tmp_path}/{c}"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * max(f.stat().st_size for f in tmp_path.rglob("*.parquet"))))
    try:
        df = N.by_grams(*sides, 70.0)
        assert {(n, n) for n, in rows[::2]} <= {tuple(r) for r in df.collect()}
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert not re.search(r"BroadcastHashJoin \[gram#\d+, ", final), final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def market(rng, ingredients: int, stores: int, twins: int, there: float, prices) -> dict:
    """Offers of which the last stores repeat the first ones four times, price by price."""
    x = prices(rng, (ingredients, stores))
    x[rng.random(x.shape) > there] = np.inf
    x = np.concatenate([x, *[x[:, :twins]] * 4], axis=1)
    return {f"i{i:02d}": B._Offers(np.flatnonzero(row < np.inf) * 3 + 5, row[row < np.inf]) for i, row in enumerate(x)}


@pytest.mark.parametrize("keep,parts", [(1, 15), (3, 15), (3, 5)])
@pytest.mark.parametrize("kind", ["ties", "rounded", "smooth"])
def test_baskets_over_a_matrix_of_prices(monkeypatch, keep, parts, kind):
    monkeypatch.setattr(B, "MOST_PARTS", parts)
    monkeypatch.setattr(B, "MANY_STORES", 10)
    monkeypatch.setattr(B, "HEAD", 16)
    rng = np.random.default_rng(len(kind) + keep)
    prices = {"ties": lambda r, s: r.integers(1, 6, s).astype(float), "rounded": lambda r, s: r.integers(1, 400, s) / 4, "smooth": lambda r, s: r.random(s) + 0.01}[kind]
    offers = market(rng, 12, 70, 20, 0.8, prices)
    m = B._Matrix.of(offers, keep)
    assert len(m.stores) <= 70 + 20 * keep
    rows = [(i, s, p) for i, o in offers.items() for s, p in zip(o.ids.tolist(), o.prices.tolist())]
    for k in range(44):
        items = sorted(rng.choice(list(offers), 1 + k % 11, replace=False).tolist())
        qty = rng.integers(1, 9, len(items)).astype(float)
        own = B._Laid(m, np.array([m.row[i] for i in items]), qty, [offers[i] for i in items])
        want = _every_pair(dict(zip(items, qty.tolist())), rows, keep)
        got = own.pairs(keep)
        assert [p[1:] for p in got] == [p[1:] for p in want] or kind == "smooth" and len(items) > 7
        assert [p[0] for p in got] == pytest.approx([p[0] for p in want])
        mono, one = own.single()
        price = {(i, s): p for i, s, p in rows}
        alone = min((sum(q * price.get((i, s), 1e15) for i, q in zip(items, qty.tolist())), s) for s in sorted({s for _, s, _ in rows}))
        assert (mono, one) == (pytest.approx(alone[0]), alone[1]) if alone[0] < 1e15 else one is None
        assert [p[0] for p in own.pairs(keep, mono)] == pytest.approx([p[0] for p in want if p[0] <= mono])


def test_a_basket_looks_at_few_of_many_stores():
    """Several times faster than a search that begins anew for each basket."""
    rng = np.random.default_rng(3)
    offers = market(rng, 12, 20_000, 0, 0.99, lambda r, s: r.random(s) * 100 + 1)
    m, took = B._Matrix.of(offers, 3), [0.0, 0.0]
    for k in range(12):
        items = sorted(rng.choice(list(offers), 4 + k % 4, replace=False).tolist())
        qty = rng.integers(1, 50, len(items)).astype(float)
        own = [offers[i] for i in items]
        B._Laid(m, np.array([m.row[i] for i in items]), qty, own).seeds  # what all baskets share
        began = time.perf_counter()
        a = B._Laid(m, np.array([m.row[i] for i in items]), qty, own).pairs(3)
        between = time.perf_counter()
        assert a == B._Search(own, qty).pairs(3)
        took = [took[0] + between - began, took[1] + time.perf_counter() - between]
    assert 3 * took[0] < took[1], took


def test_baskets_and_prices_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_BROADCAST_PRICES", 0)
    rows = [(k, f"i{k % 3}", 1.0 + k % 2) for k in range(6)]
    wanted, seen = counted(spark, rows, "basket_id long, ingredient_id string, qty_kg double")
    offers, read = counted(spark, [(f"i{i}", s, 1.0 + (i * s) % 5) for i in range(3) for s in range(4)], "ingredient_id string, store_id long, price_per_kg double")
    got = {r["basket_id"]: r["mono_total"] for r in B.optimize_basket(wanted, offers).collect()}
    assert got == {k: q for k, _, q in rows} and (seen.value, read.value) == (6, 12)


@pytest.mark.parametrize("unit", ["year", "day"])
def test_prices_of_few_periods_are_dealt_once(spark, tmp_path, monkeypatch, unit):
    """The rows move to be one a key; by year they are written as they lie then."""
    kind, dealt = type(spark.range(0)), []
    monkeypatch.setattr(kind, "hint", lambda self, name, *a, f=kind.hint: (dealt.append(name), f(self, name, *a))[1])
    root, twin = str(tmp_path / "t"), None
    for b in range(3):
        batch = stored(spark, [row(f"{b}-{k}", f"i{k % 4}", 1.0 + (7 * k + b) % 11, 50 * (k % 9) * (b + 1), str(k % 3)) for k in range(60)])
        price_store.store_prices(spark, root, batch, ("b", b), unit)
        twin = M.priced(batch) if twin is None else M.upsert_prices(twin, batch)[0]
        twin = spark.createDataFrame(twin.collect(), twin.schema)
    assert all(ids(versions.read(spark, root, t)) == ids(twin) for t in price_store.TABLES)
    assert (dealt == []) == (unit == "year")
