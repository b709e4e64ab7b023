"""Text functions against cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feira.functions import similarity as S
from feira.functions import text as T


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("price", "unit", "expected"), [
    (42.90, "cx 12x395g", (12, 4.74, 9.05, 3.58)), (15.0, "12un 395g", (12, 4.74, 3.16, 1.25)), (100.0, "2,5kg", (1, 2.5, 40.0, 100.0)),
    (5.0, "1 litro", (1, 1.0, 5.0, 5.0)), (10.0, "500ml", (1, 0.5, 20.0, 10.0)),
    (10.0, "1l", None), (10.0, "un", None), (10.0, "", None), (10.0, None, None), (0.0, "1kg", None), (-1.0, "1kg", None), (10.0, "0kg", None), (None, "1kg", None)])
def test_normalize_price(spark, price, unit, expected):
    n = one(spark, "p double, u string", (price, unit), T.normalize_price(F.col("p"), F.col("u")))
    if expected is None:
        assert n is None
    else:
        assert (n["qty"], n["price_per_kg"], n["price_per_un"]) == pytest.approx((expected[0], *expected[2:]), abs=0.011)
        assert n["total_kg"] == pytest.approx(expected[1])


@pytest.mark.parametrize(("text", "unit", "price", "validity"), [
    ("Leite 395g lata", "395g", None, ""), ("cx com 12 ovos", "cx com 12", None, ""), ("Arroz R$ 1.234,56", "", 1234.56, ""), ("válido até 05/09/26", "", None, "válido até 05/09/26"), ("até 10/10", "", None, "até 10/10")])
def test_extractors(spark, text, unit, price, validity):
    got = spark.createDataFrame([(text,)], "t string").select(T.extract_unit(F.col("t")).alias("u"), T.extract_price_brl(F.col("t")).alias("p"), T.extract_validity(F.col("t")).alias("v")).first()
    assert got["u"] == unit and got["v"] == validity
    if price is not None:
        assert got["p"] == pytest.approx(price)


def test_flyer_date_rolls_over(spark):
    day = one(spark, "t string, d date", ("até 05/01", dt.date(2026, 12, 20)), T.resolve_flyer_date(F.col("t"), F.col("d")))
    assert day == dt.date(2027, 1, 5)
    assert one(spark, "t string, d date", ("até 31/02", dt.date(2026, 1, 1)), T.resolve_flyer_date(F.col("t"), F.col("d"))) is None


@pytest.mark.parametrize(("reason", "kind"), [("Read timed out", "Timeout"), ("getaddrinfo failed", "DNSError"), ("EMFILE: too many open files", "ResourceError"), ("certificate expired", "SSLError"),
                                              ("connection refused", "ConnectError"), ("HTTP 404", "LayoutChanged"), ("captcha page", "AntiBot"), ("429", "RateLimit"), ("403 forbidden", "AntiBot"),
                                              ("odd", "Other"), (None, "Unknown"), ("", "Unknown")])
def test_classify_error(spark, reason, kind):
    assert one(spark, "r string", (reason,), T.classify_error(F.col("r"))) == kind


@pytest.mark.parametrize(("name", "food"), [("Atacado Bom", True), ("Drogaria Sul", False), ("Test Store", False), ("Catálogo X em Y", False), ("", False), (None, False)])
def test_is_food_store(spark, name, food):
    assert one(spark, "n string", (name,), T.is_food_store(F.col("n"))) is food


def test_store_name_and_clean_text(spark):
    assert one(spark, "n string", ("Assaí Atacado",), T.normalize_store_name(F.col("n"))) == "ASSA ATACADO"
    assert one(spark, "n string", ("Açúcar  União 1kg",), T.clean_text(F.col("n"))) == "ACAR UNIO 1KG"
    assert one(spark, "n string", ("AÇÚCAR",), T.deaccent(F.col("n"))) == "ACUCAR"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity(spark):
    pairs = [("leite moca", "moca leite"), ("abc", ""), ("", ""), ("manteiga aviacao", "manteiga"), ("abcdef", "acf"), ("kitten", "sitting"), ("café", "cafe")]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", S.lcs_length(F.col("a"), F.col("b")).alias("fold"), S.lcs_batched(F.col("a"), F.col("b")).alias("bits"), S.token_set_ratio(F.col("a"), F.col("b")).alias("set"))
    for r in df.collect():
        assert r["fold"] == r["bits"] == lcs(r["a"], r["b"])
    got = {(r["a"], r["b"]): r["set"] for r in df.collect()}
    assert got["leite moca", "moca leite"] == 100 and got["manteiga aviacao", "manteiga"] == 100 and got["abc", ""] == 0


def test_cosine(spark):
    assert one(spark, "a array<float>, b array<float>", ([1.0, 0.0], [1.0, 1.0]), S.cosine(F.col("a"), F.col("b"))) == pytest.approx(0.7071, abs=1e-4)
    assert one(spark, "a array<float>, b array<float>", ([0.0], [1.0]), S.cosine(F.col("a"), F.col("b"))) == 0


@pytest.mark.parametrize(("sr", "fails", "items", "p95", "days", "score"), [(1.0, 0, 10.0, 0.0, 0, 100), (0.5, 2, 1.0, 40000.0, 3, 37), (0.0, 3, 0.0, 90000.0, None, 0)])
def test_health_score(spark, sr, fails, items, p95, days, score):
    cols = [F.col(c) for c in "abcde"]
    assert one(spark, "a double, b int, c double, d double, e int", (sr, fails, items, p95, days), T.health_score(*cols)) == score
