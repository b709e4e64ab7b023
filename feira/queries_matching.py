"""Queries of the matcher's parts, of evaluation and of the collection run, with the
similarity of strings spelled out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .operators import anomaly as N
from .operators import maintain as M
from .operators import match as H
from .plans import collection
from .queries import _STATS, _catalog, as_of, prices, query
from .sources import bind
from .sql import lcs_sql, token_set_sql


_PAIRS = ", pairs AS (SELECT DISTINCT p_name AS a, lower(p_type) || ' ' || split_part(p_name, ' ', 1) AS b FROM part) "


def _pairs(s, d) -> DataFrame:
    p = bind.read_table(s, d, "part")
    return p.select(F.col("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), F.element_at(F.split("p_name", " "), 1)).alias("b")).distinct()


@query(_PAIRS + token_set_sql("pairs") + "SELECT a, b, round(token_set, 6) AS ratio FROM scored")
def token_set_ratio(s, d):
    return _pairs(s, d).select("a", "b", F.round(S.token_set_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f", pairs AS (SELECT DISTINCT p_name AS a, lower(p_type) AS b FROM part) SELECT a, b, round(200.0::DOUBLE * {lcs_sql('a', 'b')} / (length(a) + length(b)), 6) AS ratio FROM pairs")
def lcs_ratio(s, d):
    p = bind.read_table(s, d, "part").select(F.col("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return p.select("a", "b", F.round(S.fuzz_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(_PAIRS + """, w AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(b, ' ')) AS wb FROM pairs)
SELECT a, b, round(80.0::DOUBLE * (1 - 0.25::DOUBLE * (1 - len(list_intersect(wa, wb))::DOUBLE / len(wb))), 6) AS score FROM w""")
def coverage_penalty(s, d):
    return _pairs(s, d).select("a", "b", F.round(S.coverage_penalty(F.lit(80.0), F.col("a"), F.col("b")), 6).alias("score"))


@query("SELECT DISTINCT p_name AS canonical_name, p_name AS term, 'name' AS kind FROM part UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', -1), 'search' FROM part")
def alias_terms(s, d):
    return H.alias_terms(_catalog(s, d)).select("canonical_name", "term", "kind")


@query(""", w AS (SELECT DISTINCT regexp_replace(upper(unnest(string_split(p_name, ' '))), '[^A-Z0-9]', '', 'g') AS keyword FROM part) SELECT keyword FROM w
WHERE length(keyword) > 2 AND NOT regexp_matches(keyword, '[0-9]') AND keyword NOT IN (""" + ", ".join(f"'{w}'" for w in T.KEYWORD_STOPWORDS) + ")")
def keyword_set(s, d):
    return H.catalog_keywords(_catalog(s, d))


_TERMS = """, n AS (SELECT DISTINCT p_name AS canonical_name, p_name AS term, 'name' AS kind FROM part UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', -1), 'search' FROM part),
t AS (SELECT DISTINCT raw_product, upper(raw_product) AS up FROM prices),
j AS (SELECT *, upper(term) AS ut, contains(up, upper(term)) AS inside, length(term) < 8 OR NOT contains(term, ' ') AS short FROM t, n) """


@query(_TERMS + """SELECT raw_product, canonical_name, term, kind FROM j WHERE CASE WHEN kind = 'name' AND inside AND short THEN starts_with(up, ut)
WHEN kind = 'name' THEN inside OR (contains(term, ' ') AND len(list_filter(string_split(ut, ' '), lambda w: NOT list_contains(string_split(up, ' '), w))) = 0)
WHEN short THEN regexp_matches(up, '(^|[^A-Z0-9])' || ut || '([^A-Z0-9]|$)') ELSE inside END""")
def match_exact(s, d):
    j = H.catalog_match_join(bind.prices(s, d), _catalog(s, d), exclude=True)
    return j.filter(H.match_exact(F.col("raw_product"), F.col("term"), F.col("kind"))).select("raw_product", "canonical_name", "term", "kind").distinct()


@query(_TERMS + "SELECT raw_product, canonical_name, term FROM j WHERE inside")
def catalog_match_join(s, d):
    j = H.catalog_match_join(bind.prices(s, d), _catalog(s, d), exclude=False)
    return j.filter(F.upper("raw_product").contains(F.upper("term"))).select("raw_product", "canonical_name", "term").distinct()


#: The names to match: as in the catalog, with a letter lost, with words turned round and one more, and of nothing in it.
_SPELT = """, names AS (SELECT DISTINCT p_name AS n FROM part),
spelt AS (SELECT n, n AS q, 0 AS k FROM names UNION ALL SELECT n, left(n, 2) || substr(n, 4), 1 FROM names UNION ALL SELECT n, split_part(n, ' ', -1) || ' ' || split_part(n, ' ', 1) || ' xl', 2 FROM names UNION ALL SELECT n, '77 ' || length(n), 3 FROM names) """


def _spelt(s, d) -> DataFrame:
    n = bind.ingredients(s, d).select(F.col("canonical_name").alias("n"))
    part = lambda i: F.element_at(F.split("n", " "), i)
    forms = F.array(F.col("n"), F.concat(F.substring("n", 1, 2), F.col("n").substr(F.lit(4), F.length("n"))), F.concat_ws(" ", part(-1), part(1), F.lit("xl")), F.concat(F.lit("77 "), F.length("n").cast("string")))
    return n.select("n", F.posexplode(forms).alias("k", "q"))


@query(_SPELT + ", pairs AS (SELECT DISTINCT q AS a, n AS b FROM (SELECT DISTINCT q FROM spelt), names) " + token_set_sql("pairs") + """
SELECT a AS ingredient_text, CASE WHEN bool_or(a = b) THEN a WHEN max(round(token_set, 6)) >= 70 THEN arg_min(b, struct_pack(x := -round(token_set, 6), y := b)) END AS ingredient FROM scored GROUP BY 1""")
def resolve_ingredient(s, d):
    items = _spelt(s, d).select(F.col("q").alias("ingredient_text")).distinct()
    return H.resolve_ingredient(items, bind.ingredients(s, d)).select("ingredient_text", "ingredient")


@query(_SPELT + ", pairs AS (SELECT DISTINCT lower(q) AS a, n AS b FROM (SELECT DISTINCT q FROM spelt), names) " + token_set_sql("pairs") + """
SELECT a AS id, b AS canonical_name, round(greatest(token_set, CASE WHEN contains(b, a) THEN 100 + length(a) - (instr(b, a) - 1) ELSE 0 END), 6) AS score FROM scored
WHERE greatest(round(token_set, 6), CASE WHEN contains(b, a) THEN 100 + length(a) - (instr(b, a) - 1) ELSE 0 END) >= 60""")
def catalog_search(s, d):
    q = _spelt(s, d).select(F.lower("q").alias("id"), F.col("q").alias("query")).distinct()
    return H.catalog_search(q, _catalog(s, d)).withColumn("score", F.round("score", 6))


_MATCHED = _SPELT + """, c AS (SELECT DISTINCT q, n, upper(q) AS a, upper(n) AS b FROM (SELECT DISTINCT q FROM spelt), names),
hits AS (SELECT q, min(n) AS hit FROM c WHERE CASE WHEN contains(a, b) AND (length(b) < 8 OR NOT contains(b, ' ')) THEN starts_with(a, b) ELSE contains(a, b) OR (contains(b, ' ') AND len(list_filter(string_split(b, ' '), lambda w: NOT list_contains(string_split(a, ' '), w))) = 0) END GROUP BY 1),
pairs AS (SELECT * FROM c WHERE q NOT IN (SELECT q FROM hits)) """ + token_set_sql("pairs") + """,
fine AS (SELECT q, n, round(token_set * (1 - 0.25::DOUBLE * (1 - CASE WHEN NOT contains(b, ' ') AND len(wa) > 4 THEN len(list_intersect(wa, wb))::DOUBLE / len(wa) ELSE len(list_intersect(wa, wb))::DOUBLE / len(wb) END)), 6) AS score FROM scored),
best AS (SELECT q, arg_min(n, struct_pack(x := -score, y := n)) AS n, max(score) AS score FROM fine GROUP BY 1),
matched AS (SELECT q, hit AS ingredient, 100.0::DOUBLE AS score, 'exato' AS match_type FROM hits UNION ALL SELECT q, CASE WHEN score >= 80 THEN n END, score, CASE WHEN score > 0 THEN 'proximo_nome' ELSE 'none' END FROM best) """


def _names_only(s, d) -> DataFrame:
    return _catalog(s, d).withColumn("search_terms", F.array().cast("array<string>"))


def _matched(s, d) -> DataFrame:
    """The spelt names, each of its catalog name or of none."""
    spelt = _spelt(s, d).select(F.col("q").alias("raw_product")).distinct()
    return H.match_ingredient(spelt.withColumn("id", F.col("raw_product")), _names_only(s, d))


@query(_MATCHED + "SELECT * FROM matched")
def match_spelt_names(s, d):
    return _matched(s, d).select(F.col("raw_product").alias("q"), "ingredient", "score", "match_type")


@query(_MATCHED + """, cases AS (SELECT k < 3 AS positive, s.n AS expected, ingredient AS found FROM spelt s JOIN matched USING (q)),
e AS (SELECT count(*) FILTER (positive AND found = expected) AS tp, count(*) FILTER (positive AND found IS DISTINCT FROM expected) AS fn, count(*) FILTER (NOT positive AND found IS NOT NULL) AS fp, count(*) FILTER (NOT positive AND found IS NULL) AS tn FROM cases)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  (SELECT round(count(*) FILTER (match_type = 'exato') / count(*), 6) FROM spelt s JOIN matched USING (q) WHERE k < 3) AS type_accuracy FROM e""")
def matcher_eval(s, d):
    cases = _spelt(s, d).join(_matched(s, d).select(F.col("raw_product").alias("q"), "ingredient", "match_type"), "q")
    e = H.matcher_eval(cases.select((F.col("k") < 3).alias("positive"), F.col("n").alias("expected"), F.col("ingredient").alias("found"), F.lit("exato").alias("expected_type"), F.col("match_type").alias("found_type")))
    return e.select("tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "type_accuracy")])


# The collection run

def _run(s, d) -> tuple[DataFrame, DataFrame]:
    """Products of all prices, a third of them without the name of an ingredient."""
    p = bind.prices(s, d)
    text = F.when(F.pmod(F.col("store_id"), F.lit(3)) == 0, F.concat(F.lit("zz "), F.col("brand"))).otherwise(F.col("raw_product"))
    products = p.select("id", text.alias("raw_product"), "raw_price", F.concat(F.col("total_kg").cast("int").cast("string"), F.lit("kg")).alias("raw_unit"), "store_name")
    stores = bind.stores(s, d).withColumns({"logistics": F.lit("delivery"), "type": F.lit("site")})
    now = F.lit("2026-01-05 10:00:00").cast("timestamp")
    meant = bind.ingredients(s, d).select(F.col("canonical_name").alias("raw_product"), F.col("canonical_name").alias("ingredient"), F.lit(0.9).alias("semantic"))
    return collection.collection_run(products, _names_only(s, d), stores, now, semantics=meant)


@query(""", n AS (SELECT DISTINCT p_name AS n, upper(p_name) AS u, list_distinct(string_split(upper(p_name), ' ')) AS w FROM part),
t AS (SELECT DISTINCT raw_product, upper(raw_product) AS u, string_split(upper(raw_product), ' ') AS w FROM prices),
m AS (SELECT raw_product, min(n) AS ingredient FROM t JOIN n ON CASE WHEN contains(t.u, n.u) AND (length(n.n) < 8 OR len(n.w) < 2) THEN starts_with(t.u, n.u) ELSE contains(t.u, n.u) OR (len(n.w) > 1 AND len(list_intersect(n.w, t.w)) = len(n.w)) END GROUP BY 1)
SELECT ingredient AS ingredient_id, store_id::VARCHAR AS store_id, raw_price, round(round(raw_price / total_kg, 4)::DECIMAL(24, 4), 2)::DOUBLE AS price_per_kg, 'Seg' AS collected_weekday, 1.0::DOUBLE AS confidence, tier, 'site' AS source
FROM prices JOIN m USING (raw_product) WHERE store_id % 3 <> 0""")
def build_price_rows(s, d):
    return _run(s, d)[0].select("ingredient_id", "store_id", "raw_price", F.col("normalized.price_per_kg").alias("price_per_kg"), "collected_weekday", F.col("confidence").cast("double").alias("confidence"), "tier", "source")


# A catalog with aliases and excluded words, similarity of meaning and earlier decisions

#: Names and aliases; a third of the names bars texts of 'xl'. Texts: the spelt names, and some by an alias. All pairs of text and term with their scores.
_RICH = _SPELT + """, rich AS (SELECT n, n AS term, 'name' AS kind, 0 AS ord, length(n) % 3 = 0 AS bars FROM names UNION ALL SELECT n, split_part(n, ' ', 1) || ' zz', 'alias', 1, length(n) % 3 = 0 FROM names),
texts AS (SELECT DISTINCT q FROM spelt UNION SELECT 'big ' || split_part(n, ' ', 1) || ' zz 5' FROM names),
pairs AS (SELECT q, n, term, kind, ord, bars AND contains(lower(q), 'xl') AS barred, upper(q) AS a, upper(term) AS b, length(term) < 8 OR NOT contains(term, ' ') AS short FROM texts, rich) """ + token_set_sql("pairs") + """,
fine AS (SELECT *, round(token_set * (1 - 0.25::DOUBLE * (1 - CASE WHEN NOT contains(b, ' ') AND len(wa) > 4 THEN len(list_intersect(wa, wb))::DOUBLE / len(wa) ELSE len(list_intersect(wa, wb))::DOUBLE / len(wb) END)), 6) AS score FROM scored),
hits AS (SELECT q, min(n) AS hit FROM fine WHERE NOT barred AND CASE WHEN kind = 'name' AND contains(a, b) AND short THEN starts_with(a, b)
  WHEN kind = 'name' THEN contains(a, b) OR (contains(b, ' ') AND len(list_filter(string_split(b, ' '), lambda w: NOT list_contains(string_split(a, ' '), w))) = 0)
  WHEN short THEN regexp_matches(a, '(^|[^A-Z0-9])' || b || '([^A-Z0-9]|$)') ELSE contains(a, b) END GROUP BY 1),
free AS (SELECT q, n, max(score) AS score, arg_min(kind, struct_pack(x := -score, y := ord)) AS kind FROM fine WHERE NOT barred AND q NOT IN (SELECT q FROM hits) GROUP BY 1, 2),
best AS (SELECT q, arg_min(struct_pack(n := n, kind := kind), struct_pack(x := -score, y := n)) AS b, max(score) AS score FROM free GROUP BY 1),
matched AS (SELECT q, hit AS ingredient, 100.0::DOUBLE AS score, 'exato' AS match_type FROM hits
  UNION ALL SELECT q, CASE WHEN score >= 60 THEN b.n END, score, CASE WHEN score = 0 THEN 'none' WHEN b.kind = 'name' THEN 'proximo_nome' ELSE 'proximo_apelido' END FROM best),
meant AS (SELECT *, (ascii(q) % 5) / 4.0::DOUBLE AS semantic, ascii(substr(q, 2, 1)) % 2 = 0 AS cached FROM matched),
combined AS (SELECT *, CASE WHEN score >= 80 THEN score / 100 WHEN semantic > 0 THEN 0.6::DOUBLE * score / 100 + 0.4::DOUBLE * semantic ELSE score / 100 END AS combined FROM meant),
routed AS (SELECT *, CASE WHEN ingredient IS NOT NULL AND combined >= 0.8::DOUBLE THEN 'accept' WHEN ingredient IS NOT NULL AND combined >= 0.7::DOUBLE AND cached THEN 'accept' WHEN combined >= 0.7::DOUBLE THEN 'review' ELSE 'drop' END AS route FROM combined),
every AS (SELECT q, n, max(score) AS score, arg_min(struct_pack(kind := kind, term := term), struct_pack(x := -score, y := ord)) AS t FROM fine GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS rank FROM every QUALIFY rank <= 3) """


def _rich(s, d) -> DataFrame:
    n, e = F.col("canonical_name"), F.array().cast("array<string>")
    bars = F.when(F.length(n) % 3 == 0, F.array(F.lit("XL"))).otherwise(e)
    return bind.ingredients(s, d).withColumns({"aliases": F.array(F.concat(F.element_at(F.split(n, " "), 1), F.lit(" zz"))), "search_terms": e, "exclude_terms": bars})


def _rich_texts(s, d) -> DataFrame:
    n = bind.ingredients(s, d).select(F.concat(F.lit("big "), F.element_at(F.split("canonical_name", " "), 1), F.lit(" zz 5")).alias("raw_product"))
    return _spelt(s, d).select(F.col("q").alias("raw_product")).unionByName(n).distinct().withColumn("id", F.col("raw_product"))


def _routed(s, d) -> DataFrame:
    m = H.match_ingredient(_rich_texts(s, d), _rich(s, d), threshold=60.0)
    one, two = F.ascii("raw_product"), F.ascii(F.substring("raw_product", 2, 1))
    return H.route_match(m.withColumns({"semantic": (one % 5) / 4.0, "cached_confidence": F.when(two % 2 == 0, 0.9)}))


@query(_RICH + "SELECT * FROM matched")
def match_with_aliases(s, d):
    return H.match_ingredient(_rich_texts(s, d), _rich(s, d), threshold=60.0).select(F.col("raw_product").alias("q"), "ingredient", "score", "match_type")


@query(_RICH + "SELECT q, n AS canonical_name, score, CASE WHEN t.kind = 'name' THEN 'proximo_nome' ELSE 'proximo_apelido' END AS match_type, t.term AS matched_term, rank FROM top")
def rank_ingredients(s, d):
    r = H.rank_ingredients(_rich_texts(s, d), _rich(s, d), 3).select(F.col("raw_product").alias("q"), F.posexplode("top").alias("at", "x"))
    return r.select("q", "x.canonical_name", "x.score", "x.match_type", "x.matched_term", (F.col("at") + 1).cast("long").alias("rank"))


@query(_RICH + "SELECT q, ingredient, round(combined, 6) AS combined, route FROM routed")
def route_match(s, d):
    return _routed(s, d).select(F.col("raw_product").alias("q"), "ingredient", F.round("combined", 6).alias("combined"), "route")


@query(_RICH + """, words AS (SELECT r.*, top.n, top.t, list_sort(list_distinct(list_filter(string_split(upper(r.q), ' '), lambda w: w <> '' AND NOT list_contains(string_split(upper(top.n), ' '), w)))) AS rest
  FROM routed r JOIN top ON r.q = top.q AND top.rank = 1 WHERE route = 'review'),
told AS (SELECT q, array_to_string(list(n ORDER BY rank), '; ') AS suggestions FROM top WHERE score >= 55 GROUP BY 1)
SELECT w.q, coalesce(suggestions, '') AS suggestions, CASE WHEN t.kind = 'name' THEN 'proximo_nome' ELSE 'proximo_apelido' END AS match_type,
  'Tipo: ' || CASE WHEN t.kind = 'name' THEN 'semelhante ao nome do ingrediente' ELSE 'semelhante a um apelido do ingrediente' END || ' | Score: ' || floor(combined * 100)::INT || '% (RF: ' || round(score)::INT || '%, Semântico: ' || floor(semantic * 100)::INT
  || '%) | Candidato: ' || chr(39) || n || chr(39) || ' | Termo: ' || chr(39) || t.term || chr(39) || CASE WHEN len(rest) > 0 THEN ' | Palavras não matcheadas: ' || array_to_string(rest, ', ') ELSE '' END AS match_reason
FROM words w LEFT JOIN told USING (q)""")
def match_reason(s, d):
    r = H.match_reason(H.rank_ingredients(_routed(s, d).filter("route = 'review'"), _rich(s, d), 3))
    return r.select(F.col("raw_product").alias("q"), F.array_join("suggestions", "; ").alias("suggestions"), "match_type", "match_reason")


@query()
def review_rows(s, d):
    return _run(s, d)[1].select("id", "raw_product", "match_type", "match_reason", "suggestions")


# Parts of other operators

@query("""SELECT p.id, round((price_per_kg - mean) / std, 6) AS z FROM (SELECT *, avg(price_per_kg) OVER (PARTITION BY ingredient_id) AS mean, stddev_samp(price_per_kg) OVER (PARTITION BY ingredient_id) AS std
FROM prices WHERE price_per_kg > 0 AND collected_at::DATE >= as_of - 365) p WHERE std > 0""")
def outlier_join(s, d):
    return N.outlier_join(prices(s, d), as_of(), days=365).select("id", F.round("zscore", 6).alias("z"))


@query("SELECT p_name AS id, array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS brands, to_json(struct_pack(category := min(p_type))) AS category FROM part GROUP BY 1")
def price_display(s, d):
    i = bind.ingredients(s, d)
    return i.select(F.col("canonical_name").alias("id"), T.price_display(F.col("brands"), "array<string>").alias("brands"), T.price_display(F.struct("category"), "struct").alias("category"))


@query("SELECT id, CASE WHEN is_promotion AND raw_price > 0 THEN raw_price WHEN price_per_kg > 20 THEN price_per_kg ELSE 0 END AS pun FROM prices")
def extract_pun(s, d):
    return bind.prices(s, d).select("id", T.extract_pun(F.when(F.col("is_promotion"), F.col("raw_price")), F.when(F.col("price_per_kg") > 20, F.col("price_per_kg"))).alias("pun"))


@query("""SELECT p_name AS canonical_name, list_sort(list_distinct(list_concat(['known'], coalesce(list(p_name || ' ' || p_brand) FILTER (p_size >= 25), [])))) AS aliases FROM part GROUP BY 1""")
def alias_learning(s, d):
    p = bind.read_table(s, d, "part")
    seen = p.select(F.col("p_name").alias("canonical_name"), F.concat_ws(" ", "p_name", "p_brand").alias("raw_product"), (0.5 + F.col("p_size") / 100).alias("similarity"))
    out = M.alias_learning(bind.ingredients(s, d).withColumn("aliases", F.array(F.lit("known"))), seen)
    return out.select("canonical_name", F.array_sort("aliases").alias("aliases"))
