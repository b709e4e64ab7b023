"""The matcher: against brute force, over large catalogs, and on golden cases."""

from __future__ import annotations

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from feira.functions import similarity as S
from feira.functions import text as T
from feira.operators import match as H
from feira.operators import contain, similar

CATALOG = "canonical_name string, aliases array<string>, search_terms array<string>, exclude_terms array<string>, brands array<string>"


@pytest.mark.parametrize(("n", "least", "block"), [(1, 0.0, 20_000), (3, 0.0, 7), (None, 60.0, 7)])
def test_similar_terms_against_all_pairs(spark, n, least, block):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ABCDE12") for _ in range(r.randint(1, 6)))
    terms = [(f"n{k % 17}", t := " ".join(word() for _ in range(r.randint(0, 4))), "name", k, t, ["BAD"] if k % 5 == 0 else []) for k in range(40)]
    texts = [(f"{k}", " ".join(word() for _ in range(r.randint(0, 7))) + (" BAD" if k % 3 == 0 else "")) for k in range(60)] + [("same", terms[0][1]), (None, "A")]
    t = spark.createDataFrame(terms, "canonical_name string, term string, kind string, ordinal int, clean string, exclude array<string>")
    q = spark.createDataFrame([(k, c, c.lower()) for k, c in texts], "key string, clean string, low string")
    got = {(x["key"], x["canonical_name"]): (x["score"], x["ordinal"]) for x in similar.similar_terms(q, t, n, least, block=block).collect()}
    j = q.filter("key is not null").withColumnRenamed("clean", "a").crossJoin(t).filter(~T.excluded_terms(F.col("low"), F.col("exclude")))
    j = j.withColumn("score", F.round(S.coverage_penalty(S.token_set_ratio(F.col("a"), F.col("clean")), F.col("a"), F.col("clean")), 6))
    want: dict = {}
    for x in j.collect():
        key = (x["key"], x["canonical_name"])
        want[key] = min(want.get(key, (1.0, 0)), (-x["score"], x["ordinal"]))
    by: dict = {}
    for (key, name), (score, ordinal) in want.items():
        if -score >= least:
            by.setdefault(key, []).append((score, name, ordinal))
    kept = {(key, name): (pytest.approx(-score, abs=2e-6), ordinal) for key, own in by.items() for score, name, ordinal in sorted(own)[:n]}
    assert got == kept


def test_large_catalog(spark):
    # more terms than a block holds: each is still found, exactly and with a letter lost
    names = [f"ITEM{k:05} THING{k * 7919 % 100_000:05}" for k in range(25_000)]
    e: list[str] = []
    catalog = spark.createDataFrame([(x, e, e, e, e) for x in names], CATALOG)
    asked = [names[3], names[24_999].lower(), names[12_345][:8] + names[12_345][9:], "nothing of it"]
    got = {x["raw_product"]: x for x in H.match_ingredient(spark.createDataFrame([(str(k), x) for k, x in enumerate(asked)], "id string, raw_product string"), catalog).collect()}
    assert got[asked[0]]["ingredient"] == names[3] and got[asked[1]]["match_type"] == "exato" and got[asked[2]]["ingredient"] == names[12_345]
    assert got[asked[3]]["ingredient"] is None and got[asked[3]]["score"] < 60


GOLD_CATALOG = [
    ("Leite Integral", ["leite uht"], ["leite longa vida"], ["condensado", "coco", "po", "pó", "creme", "doce"], ["Itambé", "Parmalat"]),
    ("Leite Condensado", ["leite cond"], ["condensado"], ["bala"], ["Moça", "Italac"]), ("Creme de Leite", ["creme leite"], [], ["hidratante"], ["Nestlé"]),
    ("Açúcar Refinado", ["açúcar branco"], ["acucar"], ["mascavo"], ["União"]), ("Açúcar Mascavo", [], ["mascavo"], [], ["Native"]), ("Farinha de Trigo", ["farinha trigo"], [], ["rosca", "mandioca"], ["Dona Benta"]),
    ("Manteiga", ["manteiga com sal"], [], ["cacau", "amendoim"], ["Aviação"]), ("Ovos", ["ovos brancos"], ["duzia de ovos"], ["chocolate", "pascoa"], []), ("Café Torrado", ["café em pó"], ["cafe"], ["solúvel"], ["Pilão"]),
    ("Arroz Branco", ["arroz tipo 1"], ["arroz"], ["integral"], ["Camil"]), ("Feijão Carioca", ["feijao"], [], ["preto"], ["Camil"]), ("Óleo de Soja", ["oleo soja"], [], ["motor"], ["Liza"]),
]
GOLDEN = [
    ("Leite Integral Parmalat 1L", "Leite Integral"), ("LEITE INTEGRAL ITAMBÉ", "Leite Integral"), ("leite uht parmalat 1 litro", "Leite Integral"), ("Leite Longa Vida 1L", "Leite Integral"),
    ("Leite Condensado Moça 395g", "Leite Condensado"), ("LEITE COND ITALAC 395G", "Leite Condensado"), ("condensado moça lata", "Leite Condensado"), ("Leite Condesado 395g", "Leite Condensado"),
    ("Creme de Leite Nestlé 200g", "Creme de Leite"), ("CREME LEITE 200G", "Creme de Leite"), ("Creme Leite Nestle cx", "Creme de Leite"), ("Açúcar Refinado União 1kg", "Açúcar Refinado"),
    ("ACUCAR REFINADO 1KG", "Açúcar Refinado"), ("Açúcar Branco 5kg", "Açúcar Refinado"), ("Açucar Refinado", "Açúcar Refinado"), ("Açúcar Mascavo Native 1kg", "Açúcar Mascavo"), ("mascavo organico", "Açúcar Mascavo"),
    ("Farinha de Trigo Dona Benta 1kg", "Farinha de Trigo"), ("FARINHA TRIGO 5KG", "Farinha de Trigo"), ("Farinha de Trgo 1kg", "Farinha de Trigo"), ("Manteiga Aviação 200g", "Manteiga"), ("MANTEIGA COM SAL 500G", "Manteiga"),
    ("Ovos Brancos 30un", "Ovos"), ("DUZIA DE OVOS", "Ovos"), ("Ovos caipira", "Ovos"), ("Café Torrado Pilão 500g", "Café Torrado"), ("CAFÉ EM PÓ 250G", "Café Torrado"), ("Cafe Torrado 1kg", "Café Torrado"),
    ("Arroz Branco Camil 5kg", "Arroz Branco"), ("ARROZ TIPO 1 1KG", "Arroz Branco"), ("Arroz Camil", "Arroz Branco"), ("Feijão Carioca Camil 1kg", "Feijão Carioca"), ("FEIJAO CARIOCA", "Feijão Carioca"),
    ("Óleo de Soja Liza 900ml", "Óleo de Soja"), ("OLEO SOJA 900ML", "Óleo de Soja"), ("Oleo de Soja", "Óleo de Soja"), ("Carioca Feijão 1kg", "Feijão Carioca"), ("Trigo Farinha de", "Farinha de Trigo"),
    ("Detergente Neutro 500ml", None), ("Manteiga de Cacau 30g", None), ("Óleo de Motor 1L", None), ("Sabão em Barra", None), ("Hidratante Creme Corporal", None), ("Papel Toalha", None), ("Ovos de Pascoa Chocolate", None),
]


def test_golden_cases(spark):
    assert len(GOLDEN) == 45
    catalog = spark.createDataFrame([(n, a, t, x, b) for n, a, t, x, b in GOLD_CATALOG], CATALOG)
    found = H.match_ingredient(spark.createDataFrame([(str(k), t) for k, (t, _) in enumerate(GOLDEN)], "id string, raw_product string"), catalog)
    expected = spark.createDataFrame([(str(k), w, w is not None, "x") for k, (_, w) in enumerate(GOLDEN)], "id string, expected string, positive boolean, expected_type string")
    e = H.matcher_eval(found.join(expected, "id").select("positive", "expected", F.col("ingredient").alias("found"), "expected_type", F.col("match_type").alias("found_type"))).first()
    assert min(e["precision"], e["recall"], e["f1"], e["accuracy"]) >= 0.95, e


def test_resolve_store_by_containment(spark):
    r = random.Random(3)
    parts = ["extra", "hiper", "bom", "é", "pão", "s", "casa", " ", "-", "x"]
    names = ["Extra", "Hiper", "ra", "Pão", "Bom Preço", "", "Zzz"] + ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(60)]
    asked = ["Hiperextra", "EXTRA", "pao", "PÃO ", "", "  ", "nada", "q"] + ["".join(r.choices(parts, k=r.randint(1, 5))).upper() for _ in range(150)]
    for drop in (0, 1):  # with and without a blank name among the stores
        own = [(k + 10, n) for k, n in enumerate(names) if n or not drop]
        got = {x["store_name"]: x["store_id"] for x in H.resolve_store(spark.createDataFrame([*enumerate(asked), (999, None)], "id long, store_name string"), spark.createDataFrame(own, "id long, name string")).collect()}

        def fold(t):
            t = unicodedata.normalize("NFKD", t.lower().strip(" "))
            return "".join(c for c in t if not unicodedata.combining(c))

        for name in asked:
            tests = (lambda n: n == name, lambda n: fold(n) == fold(name), lambda n: fold(n) in fold(name) or fold(name) in fold(n))
            assert got[name] == next((min(k for k, n in own if f(n)) for f in tests if any(f(n) for _, n in own)), None), name
        assert got[None] is None


def test_contained_against_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choices("abcé ", k=r.randint(0, 12))) for _ in range(120)] + [None]
    terms = ["".join(r.choices("abcé ", k=r.randint(0, 4))) for _ in range(80)] + [None]
    for block in (7, 50_000):
        got = [tuple(x) for x in contain.contained(spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in terms], "term string"), block).collect()]
        assert sorted(got) == sorted({(a, b) for a in texts if a for b in terms if b and b in a})


@pytest.mark.parametrize("besides", [False, True])
def test_embedding_similarity_in_blocks(spark, besides):
    r = random.Random(6)
    vector = lambda: [r.gauss(0, 1) for _ in range(5)]
    rows = [(k, "hot" if k % 3 else f"i{k % 7}", vector() if k % 11 else [0.0] * 5 if k % 2 else None) for k in range(120)] + [(500, None, vector()), (501, "alone", vector()), (502, "hot", [1.0, 2.0])]
    terms = spark.createDataFrame([(i, v, k) for k, i, v in rows if k != 501], "ingredient string, embedding array<double>, term_id long")
    got = {x["id"]: x["similarity"] for x in H.embedding_similarity(spark.createDataFrame(rows, "id long, ingredient string, embedding array<double>"), terms, besides, block=9).collect()}

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a or ())) * math.sqrt(sum(x * x for x in b or ()))
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    want = {k: max(cosine(v, w) for j, h, w in rows if h == i and j != 501 and not (besides and j == k)) for k, i, v in rows if i not in (None, "alone")}
    assert got == pytest.approx(want)
