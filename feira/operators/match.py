"""Entity resolution: product text to catalog ingredient, brand and route.

Texts are made distinct before they are compared; products are read once for their texts
and once for the result. Exact hits come from an automaton
over all terms (contain.py) and a join on words; similarity is only computed for what nothing
names exactly, and then of few pairs (see similar.py). A catalog of any size is
taken whole, in blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..sources.work import kept
from .contain import contained, least_contained
from .similar import BLOCK_TERMS, similar_terms



def alias_terms(catalog: DataFrame) -> DataFrame:
    """canonical_name, term, kind (name, alias, search) and ordinal, in the order in
    which terms are tried: catalog by name, then name, aliases, search terms."""
    e = F.array().cast("array<string>")
    one = lambda c, kind, base: F.transform(F.coalesce(F.col(c), e), lambda t, i: F.struct(t.alias("term"), F.lit(kind).alias("kind"), (F.lit(base) + i).alias("ordinal")))
    name = F.array(F.struct(F.col("canonical_name").alias("term"), F.lit("name").alias("kind"), F.lit(0).alias("ordinal")))
    cols = ["canonical_name", *[c for c in ("exclude_terms",) if c in catalog.columns]]
    return catalog.select(*cols, F.explode(F.concat(name, one("aliases", "alias", 1), one("search_terms", "search", 100_000))).alias("t")).select(*cols, "t.*")


def catalog_keywords(catalog: DataFrame) -> DataFrame:
    """The catalog's keywords, one a row."""
    return alias_terms(catalog).select(F.explode(T.keywords(F.col("term"))).alias("keyword")).distinct()


def keyword_gate(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products (id, raw_product) that share a keyword with the catalog."""
    texts = products.select("raw_product").distinct()
    w = texts.select("raw_product", F.explode(F.array_distinct(T.gate_words(F.col("raw_product")))).alias("keyword"))
    return products.join(w.join(catalog_keywords(catalog), "keyword", "left_semi").select("raw_product").distinct(), "raw_product", "left_semi").select(*products.columns)


def _short(term: Column) -> Column:
    return (F.size(F.filter(F.split(F.trim(term), r"\s+"), lambda w: w != "")) < 2) | (F.length(F.trim(term)) < 8)


def _alone(text: Column, term: Column, beside: str) -> Column:
    """term in text with no character of a class at either side."""
    mark = "\u0001"
    return F.regexp_like(F.replace(text, term, F.lit(mark)), F.lit(f"(?<![{beside}]){mark}(?![{beside}])"))


def match_exact(product: Column, term: Column, kind: Column) -> Column:
    """Does a term name the product exactly? A canonical name may stand anywhere, or
    at the start if it is short, or all of its (two or more) words occur; other
    terms anywhere, or as whole words if they are short. With and without accents."""
    up, t = F.upper(product), F.upper(term)
    forms = [(up, t), (T.deaccent(up), T.deaccent(t))]
    inside = reduce(lambda a, b: a | b, [p.contains(x) for p, x in forms])
    starts = reduce(lambda a, b: a | b, [p.startswith(x) for p, x in forms])
    whole = reduce(lambda a, b: a | b, [_alone(p, x, "A-Z0-9") for p, x in forms])
    words = F.array_distinct(F.split(t, r"\s+"))
    every = (F.size(words) > 1) & (F.size(F.array_except(words, F.split(up, r"\s+"))) == 0)
    name = F.when(inside & _short(term), starts).otherwise(inside | every)
    return F.when(kind == "name", name).otherwise(F.when(_short(term), whole).otherwise(inside))


def catalog_match_join(products: DataFrame, catalog: DataFrame, exclude: bool) -> DataFrame:
    """Distinct texts with the terms that may name them exactly: those that stand in
    the text (accents folded), and names of which the longest word does. No term that
    match_exact takes is missing."""
    fold = lambda c: T.deaccent(F.upper(c))
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    texts = products.select("raw_product").filter("raw_product is not null").distinct().withColumn("text", fold(F.col("raw_product")))
    terms = alias_terms(catalog).withColumn("folded", fold(F.col("term")))
    inside = contained(texts.select("text"), terms.select(F.col("folded").alias("term"))).select("text", F.col("term").alias("folded"))
    longest = F.aggregate(words(F.col("folded")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    several = terms.filter((F.col("kind") == "name") & (F.size(words(F.col("folded"))) > 1)).select("folded", longest.alias("word"))
    by_word = texts.select("text", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(several.distinct(), "word").select("text", "folded")
    j = texts.join(inside.unionByName(by_word).distinct(), "text").join(terms, "folded").drop("text", "folded")
    if exclude and "exclude_terms" in catalog.columns:
        j = j.filter(~T.excluded_terms(F.col("raw_product"), F.col("exclude_terms")))
    return j


def _ranked(texts: DataFrame, catalog: DataFrame, n: int, exclude: bool) -> DataFrame:
    """The n ingredients most similar to each of the texts (raw_product)."""
    terms = alias_terms(catalog).withColumn("clean", T.clean_text(F.col("term")))
    barred = F.col("exclude_terms") if exclude and "exclude_terms" in catalog.columns else F.array().cast("array<string>")
    t = texts.select(F.col("raw_product").alias("key"), T.clean_text(F.col("raw_product")).alias("clean"), F.lower("raw_product").alias("low"))
    out = similar_terms(t, terms.withColumn("exclude", barred), n)
    kind = F.when(F.col("kind") == "name", "proximo_nome").otherwise("proximo_apelido")
    return out.withColumnRenamed("key", "raw_product").withColumn("match_type", kind)


def match_ingredient(products: DataFrame, catalog: DataFrame, threshold: float = 80.0) -> DataFrame:
    """products (id, raw_product) with ingredient, score and match_type.

    The first exact hit in catalog order wins with 100; else the best penalised
    score, the earliest term on ties; below the threshold the ingredient is null
    and the score is kept. Scores are rounded to 6 places before they are compared.
    A null text matches nothing.
    """
    matched = match_texts(distinct_texts(products), _terms_only(catalog), threshold)
    out = products.join(matched, "raw_product", "left")
    return out.withColumns({"score": F.coalesce("score", F.lit(0.0)), "match_type": F.coalesce("match_type", F.lit("none"))})


def distinct_texts(products: DataFrame) -> DataFrame:
    """The texts of products (raw_product), once each, without null."""
    return kept(products.select("raw_product").filter("raw_product is not null").distinct(), "texts")


def _terms_only(catalog: DataFrame) -> DataFrame:
    """What of a catalog names products."""
    return kept(catalog.select("canonical_name", *[c for c in ("aliases", "search_terms", "exclude_terms") if c in catalog.columns]), "catalog")


def match_texts(texts: DataFrame, catalog: DataFrame, threshold: float = 80.0) -> DataFrame:
    """distinct_texts with ingredient, score and match_type, see match_ingredient."""
    j = catalog_match_join(texts, catalog, exclude=True)
    hit = kept(j.filter(match_exact(F.col("raw_product"), F.col("term"), F.col("kind"))).groupBy("raw_product").agg(F.min("canonical_name").alias("ingredient"))
               .select("raw_product", "ingredient", F.lit(100.0).alias("score"), F.lit("exato").alias("match_type")), "hits")
    near = _ranked(texts.join(hit.select("raw_product"), "raw_product", "left_anti"), catalog, 1, exclude=True)
    near = near.select("raw_product", F.when(F.col("score") >= threshold, F.col("canonical_name")).alias("ingredient"), "score", F.when(F.col("score") > 0, F.col("match_type")).otherwise("none").alias("match_type"))
    out = texts.join(hit.unionByName(near), "raw_product", "left")
    return kept(out.withColumns({"score": F.coalesce("score", F.lit(0.0)), "match_type": F.coalesce("match_type", F.lit("none"))}), "matched")


def rank_ingredients(products: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """products with top: the n best ingredients as (canonical_name, score, match_type,
    matched_term); neither exact hits nor excluded terms play a part."""
    top = _ranked(distinct_texts(products), _terms_only(catalog), n, exclude=False)
    row = F.struct((-F.col("score")).alias("o"), "canonical_name", "score", "match_type", F.col("term").alias("matched_term"))
    top = top.groupBy("raw_product").agg(F.array_sort(F.collect_list(row)).alias("top"))  # n of each text
    return products.join(kept(top.withColumn("top", F.transform("top", lambda x: x.dropFields("o"))), "ranked"), "raw_product", "left")


#: Vectors of a label that meet at a time, from either side.
BLOCK_VECTORS = 2000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix, of length 1 (or 0); shorter ones end in zeros."""
    rows = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = np.nan_to_num(rows.flatten().to_numpy(zero_copy_only=False).astype(float))
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def embedding_similarity(products: DataFrame, terms: DataFrame, besides: bool = False, block: int = BLOCK_VECTORS) -> DataFrame:
    """Largest cosine of a product's vector with the vectors of its ingredient:
    products (id, ingredient, embedding), terms (ingredient, embedding) -> id,
    ingredient, similarity. With besides, terms also have term_id, and a product is
    not compared with the term of its own id.

    Vectors of one ingredient meet in blocks, as two matrices; a frequent ingredient is
    cut into many such cells, and of each cell one number a product is passed on. A
    null vector is similar to nothing (0)."""
    p = products.select("id", "ingredient", "embedding")
    # under names of their own, as both sides may come from one table
    t = terms.select(F.col("ingredient").alias("ingredient"), F.col("embedding").alias("vector"), (F.col("term_id") if besides else F.lit(None).cast(dict(p.dtypes)["id"])).alias("term_id"))
    cuts = lambda d, c: d.groupBy("ingredient").agg(F.ceil(F.count("*") / block).alias(c))
    both = cuts(p, "rows").join(cuts(t, "cols"), "ingredient")
    tasks = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = ["ingredient", "row", "col"]
    a = p.join(both, "ingredient").withColumn("row", F.pmod(F.xxhash64("id"), "rows")).withColumn("col", every("cols")).select(*cell, "id", "embedding").repartition(tasks, *cell)
    b = t.join(both, "ingredient").withColumn("col", F.pmod(F.xxhash64("term_id", "vector"), "cols")).withColumn("row", every("rows")).select(*cell, "term_id", "vector").repartition(tasks, *cell)

    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        best = np.zeros(0)
        if own.num_rows and far.num_rows:
            x, y = _matrix(own.column("embedding")), _matrix(far.column("vector"))
            width = min(x.shape[1], y.shape[1])
            like = x[:, :width] @ y[:, :width].T
            if besides:
                ids, theirs = (np.array(c.to_pylist(), object) for c in (own.column("id"), far.column("term_id")))
                like[ids[:, None] == theirs] = -np.inf
            best = like.max(1)
        keep = np.flatnonzero(best > -np.inf)
        return pa.table({"id": own.column("id").take(pa.array(keep)), "ingredient": own.column("ingredient").take(pa.array(keep)), "similarity": pa.array(best[keep], pa.float64())})

    kinds = dict(p.dtypes)
    out = a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(run, f"id {kinds['id']}, ingredient {kinds['ingredient']}, similarity double")
    return out.groupBy("id", "ingredient").agg(F.max("similarity").alias("similarity"))


def route_match(matched: DataFrame, accept: float = 0.80, review: float = 0.70) -> DataFrame:
    """matched (ingredient, score, semantic, cached_confidence optional) with combined
    and route: accept, review or drop. A score of 80 and more is accepted at once; a
    cached decision of 0.85 and more settles the range between the thresholds."""
    combined = T.combined_score(F.col("score"), F.coalesce("semantic", F.lit(0.0)))
    known = F.col("ingredient").isNotNull()
    cached = F.coalesce(F.col("cached_confidence") >= 0.85, F.lit(False)) if "cached_confidence" in matched.columns else F.lit(False)
    out = matched.withColumn("combined", F.when(F.col("score") >= 80, F.col("score") / 100).otherwise(combined))
    return out.withColumn("route", F.when(known & (F.col("combined") >= accept), "accept").when(known & (F.col("combined") >= review) & cached, "accept")
                          .when(F.col("combined") >= review, "review").otherwise("drop"))


def decision_cache(products: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """products (raw_product, brand) with the cached decision of the same text and
    brand that is not too old (cache: key, ingredient, confidence, created_at)."""
    c = cache.filter(F.col("created_at") >= now - F.expr(f"interval {ttl_days} days")).groupBy("key").agg(F.max_by(F.struct("ingredient", "confidence"), "created_at").alias("c"))
    return (products.withColumn("key", T.decision_key(F.col("raw_product"), F.col("brand"))).join(c, "key", "left")
            .withColumns({"cached_ingredient": F.col("c.ingredient"), "cached_confidence": F.col("c.confidence")}).drop("c"))


def decision_cache_stats(cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(F.col("created_at") < now - F.expr(f"interval {ttl_days} days")).alias("expired"))


#: How match types are told to a reviewer.
TYPE_LABELS = {"proximo_nome": "semelhante ao nome do ingrediente", "proximo_apelido": "semelhante a um apelido do ingrediente", "exato": "exato",
               "contido": "nome do ingrediente contido no produto"}


def unmatched_words(product: Column, canonical: Column) -> Column:
    """Words of a product that the canonical name lacks, sorted."""
    words = lambda c: F.filter(F.split(T.clean_text(c), " "), lambda w: w != "")
    return F.array_sort(F.array_except(words(product), words(canonical)))


def match_reason(ranked: DataFrame) -> DataFrame:
    """Ranked products (top, score, combined, semantic) with suggestions (score 55 and
    more), match_type and match_reason."""
    best = F.get(F.col("top"), 0)
    label = reduce(lambda a, kv: a.when(best["match_type"] == kv[0], kv[1]), TYPE_LABELS.items(), F.when(F.lit(False), "")).otherwise(best["match_type"])
    rest = unmatched_words(F.col("raw_product"), best["canonical_name"])
    text = F.concat(F.lit("Tipo: "), label, F.lit(" | Score: "), F.floor(F.col("combined") * 100).cast("string"), F.lit("% (RF: "), F.round("score", 0).cast("int").cast("string"),
                    F.lit("%, Semântico: "), F.floor(F.coalesce("semantic", F.lit(0.0)) * 100).cast("string"), F.lit("%) | Candidato: '"), best["canonical_name"],
                    F.lit("' | Termo: '"), best["matched_term"], F.lit("'"), F.when(F.size(rest) > 0, F.concat(F.lit(" | Palavras não matcheadas: "), F.array_join(rest, ", "))).otherwise(""))
    none = F.concat(F.lit("Score "), F.round("score", 0).cast("int").cast("string"), F.lit("% - nenhum candidato acima de 55%"))
    return ranked.withColumns({"suggestions": F.transform(F.filter("top", lambda x: x["score"] >= 55), lambda x: x["canonical_name"]),
                               "match_type": F.coalesce(best["match_type"], F.lit("")), "match_reason": F.when(best.isNotNull(), text).otherwise(none)})


def extract_brand(products: DataFrame, catalog: DataFrame, by_ingredient: bool = True, threshold: float = 80.0, default: str | None = "Desconhecido") -> DataFrame:
    """products (id, raw_product, ingredient) with brand: of the ingredient's brands (or
    of all), the first found as a word, else the first not inside another word,
    else the most similar to a word of the product at the threshold."""
    cols = ["canonical_name"] if by_ingredient else []
    b = catalog.select("canonical_name", F.posexplode("brands").alias("ord", "brand"))
    if not by_ingredient:
        b = b.groupBy("brand").agg(F.min(F.struct("canonical_name", "ord")).alias("o")).select("brand", F.col("o").alias("ord"))
    b = b.withColumn("bn", T.deaccent(F.upper("brand")))
    p = products.select("raw_product", *(["ingredient"] if by_ingredient else [])).distinct().withColumn("tn", T.deaccent(F.upper("raw_product")))
    j = p.join(b, F.col("ingredient") == F.col("canonical_name")) if cols else reduce(DataFrame.unionByName, [p.crossJoin(F.broadcast(x)) for x in _blocks(b)])
    word, part = _alone(F.col("tn"), F.col("bn"), "A-Z0-9_"), _alone(F.col("tn"), F.col("bn"), "A-Z")
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("tn", r"[^A-Z\s]", " "), r"\s+"), lambda w: w != ""))
    near = F.coalesce(F.array_max(F.transform(words, lambda w: S.fuzz_ratio(w, F.col("bn")))), F.lit(0.0))
    j = j.withColumn("level", F.when(word, 1).when(part, 2).otherwise(3)).withColumn("near", F.when(F.col("level") == 3, F.round(near, 6)).otherwise(0.0))
    keys = ["raw_product", *(["ingredient"] if by_ingredient else [])]
    best = j.groupBy(*keys).agg(F.min_by(F.struct("brand", "level", "near"), F.struct("level", -F.col("near"), "ord")).alias("b"))
    best = best.select(*keys, F.when((F.col("b.level") < 3) | (F.col("b.near") >= threshold), F.col("b.brand")).alias("brand"))
    return products.drop("brand").join(best, keys, "left").withColumn("brand", F.coalesce("brand", F.lit(default)))


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The catalog's brands in blocks of about BLOCK_TERMS rows."""
    n = max(1, -(-terms.count() // BLOCK_TERMS))
    return [terms.filter(F.pmod(F.xxhash64("brand"), F.lit(n)) == k) for k in range(n)]


def build_price_rows(matched: DataFrame, stores: DataFrame, now: Column) -> DataFrame:
    """Accepted products with their store's fields as price rows."""
    s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.coalesce("tier", F.lit(3)).alias("tier"), "city", "logistics", F.col("type").alias("source"))
    n = T.normalize_price(F.col("raw_price"), F.col("raw_unit"))
    return matched.join(s, "store_name", "left").select(
        F.col("ingredient").alias("ingredient_id"), F.coalesce(F.col("store_id").cast("string"), F.lower(F.regexp_replace("store_name", " ", "_"))).alias("store_id"),
        F.coalesce("source", F.lit("automated")).alias("source"), "store_name", "raw_product", "raw_price", "raw_unit", T.extract_validity(F.col("raw_product")).alias("validity_raw"),
        T.weekday_pt(F.to_date(now)).alias("collected_weekday"), T.detect_promotion(F.col("raw_product"), F.col("raw_unit")).alias("is_promotion"), F.coalesce("tier", F.lit(3)).alias("tier"),
        F.col("combined").alias("confidence"), n.alias("normalized"), F.coalesce("city", F.lit("")).alias("city"), F.coalesce("logistics", F.lit("pickup_local")).alias("logistics"))


def catalog_search(queries: DataFrame, catalog: DataFrame, least: float = 60.0) -> DataFrame:
    """User queries (id, query) -> ingredients with score: 100 + length - position for
    a substring of the name, else the best token-set similarity of name and aliases."""
    terms = alias_terms(catalog).filter("kind <> 'search'").withColumn("clean", F.lower("term")).withColumn("exclude", F.array().cast("array<string>"))
    q = queries.select("id", F.lower(F.trim("query")).alias("key"))
    asked = q.select("key").distinct().withColumn("clean", F.col("key")).withColumn("low", F.col("key"))
    near = similar_terms(asked, terms, None, least, penalty=0.0).select("key", "canonical_name", "score")
    # a query stands in a name if its first three letters do
    name, n = F.lower("canonical_name"), F.length("canonical_name")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(*[name.substr(i, F.lit(k)) for k in (1, 2, 3)]))))
    names = catalog.select("canonical_name", F.explode(grams).alias("gram"))
    inside = asked.withColumn("gram", F.substring("key", 1, 3)).join(names, "gram").withColumn("at", F.instr(name, F.col("key"))).filter("at > 0")
    inside = inside.select("key", "canonical_name", (100.0 + F.length("key") - (F.col("at") - 1)).alias("score"))
    best = near.unionByName(inside).groupBy("key", "canonical_name").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    return q.join(best, "key").select("id", "canonical_name", "score")


def resolve_store(items: DataFrame, stores: DataFrame) -> DataFrame:
    """items (id, store_name) with store_id: exact name, else equal without case and
    accents, else one name inside the other, wherever; ties to the smallest id. A
    blank name stands in every name. A null one resolves to nothing."""
    fold = lambda c: T.deaccent(F.lower(F.trim(c)))
    s = stores.select(F.col("id").alias("sid"), F.col("name").alias("sname"), fold(F.col("name")).alias("sfold"))
    i = items.select("store_name").filter("store_name is not null").distinct().withColumn("fold", fold(F.col("store_name")))
    exact = i.join(s, F.col("store_name") == F.col("sname")).select("store_name", "sid", F.lit(1).alias("rank"))
    same = i.join(s, F.col("fold") == F.col("sfold")).select("store_name", "sid", F.lit(2).alias("rank"))
    others = s.select(F.col("sfold").alias("other"), F.col("sid").alias("id"))
    inside = reduce(DataFrame.unionByName, least_contained(i.select(F.col("fold").alias("name")), others))
    sid = dict(s.dtypes)["sid"]
    part = i.join(inside, F.col("fold") == F.col("name")).select("store_name", F.col("id").cast(sid).alias("sid"), F.lit(3).alias("rank"))
    blank = s.agg(F.min("sid").alias("any"), F.min(F.when(F.col("sfold") == "", F.col("sid"))).alias("blank"))  # one row
    every = i.crossJoin(F.broadcast(blank)).select("store_name", F.when(F.col("fold") == "", F.col("any")).otherwise(F.col("blank")).alias("sid"), F.lit(3).alias("rank")).filter("sid is not null")
    best = reduce(DataFrame.unionByName, (exact, same, part, every)).groupBy("store_name").agg(F.min(F.struct("rank", "sid")).alias("b"))
    return items.join(best.select("store_name", F.col("b.sid").alias("store_id")), "store_name", "left")


def resolve_ingredient(items: DataFrame, catalog: DataFrame, least: float = 70.0) -> DataFrame:
    """items (id, ingredient_text) with ingredient: the equal name, else the most
    similar one (accents and case folded) at the threshold."""
    fold = lambda c: T.deaccent(F.lower(F.trim(c)))
    i = items.select(F.col("ingredient_text").alias("key")).distinct()
    same = i.join(catalog.select(F.col("canonical_name").alias("key")).distinct(), "key", "left_semi")
    terms = catalog.select("canonical_name", F.col("canonical_name").alias("term"), F.lit("name").alias("kind"), F.lit(0).alias("ordinal"), fold(F.col("canonical_name")).alias("clean"), F.array().cast("array<string>").alias("exclude"))
    rest = i.join(same, "key", "left_anti").withColumn("clean", fold(F.col("key"))).withColumn("low", F.lit(""))
    best = same.select("key", F.col("key").alias("ingredient")).unionByName(similar_terms(rest, terms, 1, least, penalty=0.0).select("key", F.col("canonical_name").alias("ingredient")))
    return items.join(best.withColumnRenamed("key", "ingredient_text"), "ingredient_text", "left")


def matcher_eval(cases: DataFrame) -> DataFrame:
    """cases (positive, expected, found, expected_type, found_type) -> tp, fp, fn, tn,
    precision, recall, f1, accuracy, type_accuracy. A wrong ingredient on a positive
    case is a false negative only."""
    right = F.col("found").isNotNull() & (F.col("found") == F.col("expected"))
    g = cases.agg(F.count_if(F.col("positive") & right).alias("tp"), F.count_if(F.col("positive") & ~F.coalesce(right, F.lit(False))).alias("fn"),
                  F.count_if(~F.col("positive") & F.col("found").isNotNull()).alias("fp"), F.count_if(~F.col("positive") & F.col("found").isNull()).alias("tn"),
                  F.count_if(F.col("positive") & (F.col("expected_type") == F.col("found_type"))).alias("typed"), F.count_if("positive").alias("pos"))
    d = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = d(F.col("tp"), F.col("tp") + F.col("fp")), d(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), d(2 * p * r, p + r).alias("f1"),
                    d(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), d(F.col("typed"), F.col("pos")).alias("type_accuracy"))
