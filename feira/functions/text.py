"""Column functions over product, flyer and log text. None runs Python per row."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, keywords and word lists of the domain.
UNIT = "(kg|g|ml|litro|litros)"
WEIGHTS = (rf"(?i)(\d+)\s*x\s*([\d,.]+)\s*{UNIT}", rf"(?i)([\d,.]+)\s*{UNIT}", rf"(?i)(\d+)\s*x\s*([\d,.]+)(?:\s*{UNIT})?")
COUNTS = (r"(?i)(\d+)\s*(?:uni|un|und|unidade|uns?)\b", r"(?i)pacote\s*com\s*(\d+)", r"(?i)cx\s*(?:com\s*)?(\d+)", r"(?i)cx\w*\s*(?:com\s*)?(\d+)")
PACKS = (r"(?i)(lata\s*\d+\s*(?:kg|g|ml))", r"(?i)(balde\s*\d+\s*(?:kg|g|ml))", r"(?i)(\d+\s*x\s*[\d.,]+\s*(?:kg|g|ml|un|l))",
         r"(?i)([\d.,]+\s*(?:kg|g|ml|un|l)\b)", r"(?i)(cx\s*(?:com\s*)?\d+)", r"(?i)(pacote\s*(?:com\s*)?\d+)")
PRICE = r"(?:R\$\s*)?(\d{1,3}(?:\.\d{3})*(?:,\d{2})?)\b"
VALID_UNTIL = r"(?iu)((?:válido|valido|válida|valida)\s*(?:até|ate)\s*:?\s*\d{2}/\d{2}(?:/\d{2,4})?)"
UNTIL = r"(?iu)((?:até|ate)\s*:?\s*\d{2}/\d{2}(?:/\d{2,4})?)"
PROMOTION = r"(?i)promo|oferta|desconto|\d+%\s*off"
PACKAGING = ("papel", "caixa", "embalagem", "forma", "forminha", "folha", "chenille", "pelúcia", "lembrancinha", "decorativo",
             "artesanato", "pincel", "brinquedo", "festa", "saco", "cartinha", "blister", "haste", "adereço", "enfeite", "topper",
             "marca texto", "caneca", "vela")
KEYWORD_STOPWORDS = ("DE", "DA", "DO", "EM", "COM", "SEM", "PARA", "TIPO", "TOP", "MIX", "FOOD", "SACO", "LATA", "POTE", "CAIXA", "PACOTE",
                     "EMBALAGEM", "FORM", "FOLHA", "TIPOS", "SABORES", "TODOS", "VARIOS", "C", "UN", "CX", "PC", "PT", "GR", "G", "KG", "ML",
                     "UNIDADE", "UNIDADES", "BARRA", "TABLETE")
NON_FOOD = ("boticário", "boticario", "magazine", "casas bahia", "renner", "riachuelo", "marisa", "c&a", "cea", "drogaria", "farmacia",
            "farmácia", "drogasil", "drogão", "drogao", "polishop", "fast shop", "electrolux", "lg", "samsung", "sony", "apple", "posto",
            "gasolina", "combustivel", "pet", "petshop", "papelaria", "livraria", "academia", "ótica", "otica", "oculos", "seguros", "banco",
            "imobiliária", "imobiliaria", "automoveis", "carro", "moto", "cama mesa banho", "material de construcao", "construcao",
            "construção", "presentes", "souvenir", "brinquedos", "perfumaria", "cosmeticos", "cosméticos", "lavanderia", "telefonia",
            "informatica", "moda", "calçados", "calcados", "havan", "cem", "quero-quero", "solar", "eudora", "jequiti", "ferreira costa",
            "temu", "decathlon", "tupperware", "casa e video")
TEST_PREFIXES = ("cleanup store ", "test ", "e2e ", "_test_", "ocr test ")
CATALOG_PREFIXES = ("catálogo ", "catalogo ")
WEEKDAYS = ("Seg", "Ter", "Qua", "Qui", "Sex", "Sab", "Dom")
#: Ordered (class, substrings): the first that is found names the error.
ERROR_CLASSES = (
    ("Timeout", ("timeout", "timed out")),
    ("DNSError", ("dns", "no address", "name resolution", "getaddrinfo", "errno -5")),
    ("ResourceError", ("errno 11", "resource temporarily unavailable", "too many open files", "emfile")),
    ("SSLError", ("ssl", "tls", "certificate")),
    ("ProxyConfigError", ("proxy",)),
    ("ConnectError", ("connect",)),
    ("LayoutChanged", ("404", "not found", "parse", "selector", "no element")),
    ("AntiBot", ("captcha", "robot")),
    ("RateLimit", ("rate", "429", "too many")),
    ("AntiBot", ("forbidden", "403", "cloudflare")),
)
PERMANENT = ("LayoutChanged", "AntiBot")


def _plain_letters() -> tuple[str, str]:
    """Characters that decompose into one character and marks, and those characters;
    then the marks alone, which go."""
    def base(c: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))

    found = {c: base(c) for c in map(chr, range(0xA0, 0x10000)) if not 0xD800 <= ord(c) < 0xE000}
    one = [c for c, x in found.items() if len(x) == 1 and x != c]
    return "".join(one) + "".join(c for c, x in found.items() if not x), "".join(found[c] for c in one)


_ACCENTED, _PLAIN = _plain_letters()


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null when there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def _ended(pattern: str, ascii_words: bool) -> str:
    """A pattern whose \\b stand behind letters or digits, with the characters of a word
    spelled out (what \\b takes for one differs between Java's releases): all letters and
    numbers, or those of ASCII."""
    return pattern.replace(r"\b", "(?![A-Za-z0-9_])" if ascii_words else r"(?![\p{L}\p{N}_])")


def contains_any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def deaccent(text: Column) -> Column:
    """Letters without their marks, by compatible decomposition. Characters that
    decompose into several (ligatures, syllables) stay as they are."""
    return F.translate(text, _ACCENTED, _PLAIN)


def clean_text(text: Column) -> Column:
    """Upper case, only A-Z, 0-9 and single spaces; accented letters go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r"[^A-Z0-9\s]", ""), r"\s+", " "))


def normalize_store_name(name: Column) -> Column:
    """Upper case, then everything but A-Z, 0-9 and the space away (upper case comes first)."""
    return F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", "")


def normalize_price(price: Column, unit: Column) -> Column:
    """struct(qty, unit_kg, total_kg, price_per_kg, price_per_un), or null when the
    price is not positive or no weight is found.

    A comma is a point. Weight patterns are tried in order, and one whose weight is
    no number gives way to the next; of the count patterns the last that matches
    sets the quantity. A weight or a count of zero gives null. Prices per unit are
    rounded to 4, then 2 decimals.
    """
    u = F.regexp_replace(F.trim(unit), ",", ".")
    qty, weight, measure = [], [], []
    for k, p in enumerate(WEIGHTS):
        hit = F.regexp_like(u, F.lit(p))
        w = F.when(hit, F.regexp_extract(u, p, 1 if k == 1 else 2)).try_cast("double")
        weight.append(w)
        qty.append(F.lit(1) if k == 1 else F.when(hit, F.regexp_extract(u, p, 1)).try_cast("int"))
        measure.append(F.lower(F.regexp_extract(u, p, 2 if k == 1 else 3)))
    pick = [F.when(w.isNotNull(), F.struct(q.alias("q"), w.alias("w"), m.alias("m"))) for q, w, m in zip(qty, weight, measure)]
    best = F.coalesce(*pick)
    in_kg = F.when(best["m"].isin("kg", "litro", "litros"), best["w"]).otherwise(best["w"] / 1000)
    count = F.coalesce(*[_first(u, p).try_cast("int") for p in reversed(COUNTS)], best["q"])
    total = count * in_kg
    ok = (price > 0) & (total > 0)
    per = lambda d: F.round(F.round(price / d, 4), 2)
    return F.when(ok, F.struct(count.alias("qty"), in_kg.alias("unit_kg"), total.alias("total_kg"),
                               per(total).alias("price_per_kg"), per(count).alias("price_per_un")))


def extract_unit(name: Column, ascii_words: bool = False) -> Column:
    """The first of six kinds of pack size in a product name; '' if none. With ascii_words
    a measure may end before an accented letter."""
    return F.coalesce(*[F.trim(_first(name, _ended(p, ascii_words))) for p in PACKS], F.lit(""))


def price_pattern(ascii_words: bool = False) -> str:
    return _ended(PRICE, ascii_words)


def extract_price_brl(text: Column, ascii_words: bool = False) -> Column:
    """The first Brazilian-style number (1.234,56) as a double; null if none."""
    raw = _first(text, price_pattern(ascii_words))
    return F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def extract_validity(text: Column) -> Column:
    """'válido até dd/mm[/yy]', else 'até dd/mm', else ''."""
    return F.coalesce(_first(text, VALID_UNTIL), _first(text, UNTIL), F.lit(""))


def resolve_flyer_date(text: Column, today: Column) -> Column:
    """The first dd/mm as a date, next year when its month is before today's; null
    for a date that does not exist."""
    day, month = _first(text, r"(\d{1,2})/(\d{1,2})", 1), _first(text, r"(\d{1,2})/(\d{1,2})", 2)
    year = F.year(today) + (month.cast("int") < F.month(today)).cast("int")
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def detect_promotion(product: Column, unit: Column) -> Column:
    return F.regexp_like(F.concat_ws(" ", product, unit), F.lit(PROMOTION))


def weekday_pt(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(day) + 1)


def default_validity(until: Column, collected: Column, days: int = 7) -> Column:
    """valid_until, or so many days after collection where it is missing."""
    return F.coalesce(until, F.date_add(F.to_date(collected), days))


def keywords(text: Column) -> Column:
    """Words that can name an ingredient: longer than 2, no digits, no stopwords."""
    words = F.transform(F.split(F.upper(text), r"\s+"), lambda w: F.regexp_replace(w, "[^A-Z0-9]", ""))
    stop = F.array(*[F.lit(w) for w in KEYWORD_STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.regexp_like(w, F.lit("[0-9]")) & ~F.array_contains(stop, w)))


def gate_words(product: Column) -> Column:
    """Words of a product text that are compared with the catalog's keywords."""
    words = F.filter(F.split(product, r"\s+"), lambda w: F.length(w) > 2)
    return F.transform(words, lambda w: F.regexp_replace(F.upper(w), "[^A-Z0-9]", ""))


def excluded_terms(product: Column, terms: Column) -> Column:
    """Does the product contain one of the array's terms, whatever the case?"""
    return F.coalesce(F.exists(terms, lambda t: F.lower(product).contains(F.lower(t))), F.lit(False))


def packaging_tokens(product: Column) -> Column:
    return contains_any(F.lower(product), PACKAGING)


def is_food_store(name: Column) -> Column:
    """Not empty, no test or catalogue prefix, none of the non-food words."""
    low = F.trim(F.lower(name))
    bad = reduce(lambda a, b: a | b, [low.startswith(p) for p in TEST_PREFIXES + CATALOG_PREFIXES])
    return F.coalesce((name != "") & ~bad & ~contains_any(low, NON_FOOD), F.lit(False))


def classify_error(reason: Column) -> Column:
    """One of nine classes by the first rule that fits; Unknown without a reason."""
    low, out = F.lower(reason), F.when(F.coalesce(reason, F.lit("")) == "", "Unknown")
    for name, terms in ERROR_CLASSES:
        out = out.when(contains_any(low, terms), name)
    return out.otherwise("Other")


def is_transient(error_class: Column) -> Column:
    return ~error_class.isin(*PERMANENT)


def latency_label(ms: Column) -> Column:
    return F.when(ms > 60_000, "slow").when(ms > 30_000, "moderate").otherwise("fast")


def default_frequency(tier: Column) -> Column:
    """Minutes between collections by tier."""
    return F.when(tier == 1, 10_080).when(tier.isin(2, 3), 1440).when(tier == 4, 43_200).otherwise(1440)


def freshness_bucket(day: Column, as_of: Column) -> Column:
    age = F.datediff(as_of, day)
    return F.when(age.isNull(), "n/d").when(age <= 7, "ok").when(age <= 30, "warn").otherwise("stale")


def health_score(success_rate: Column, failures: Column, avg_items: Column, p95_ms: Column, days_since: Column) -> Column:
    """0 to 100 from success (30), failures (25), items (20), latency (15) and recency (10)."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return F.least(F.lit(100), (
        F.floor(z(success_rate) * 30) + F.when(z(failures) == 0, 25).when(failures == 1, 15).when(failures == 2, 5).otherwise(0)
        + F.least(F.lit(20), F.floor(z(avg_items) * 2)) + F.when(z(p95_ms) < 30_000, 15).when(p95_ms < 60_000, 8).otherwise(0)
        + F.when(days_since.isNull(), 0).otherwise(F.greatest(F.lit(0), 10 - days_since))).cast("int"))


def health_label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 50, "Fair").when(score >= 25, "Poor").otherwise("Critical")


def decision_key(product: Column, brand: Column) -> Column:
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat(part(product), F.lit("|"), part(brand)), 256)


def combined_score(fuzzy: Column, semantic: Column) -> Column:
    """0.6 fuzzy (0 to 100) and 0.4 semantic; fuzzy alone without a semantic score."""
    return F.when(semantic > 0, 0.6 * fuzzy / 100 + 0.4 * semantic).otherwise(fuzzy / 100)


def name_quality(name: Column) -> Column:
    """0 to 1: share of words longer than 3 letters (0.8) and of non-digits (0.2)."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    long = F.size(F.filter(words, lambda w: F.length(w) > 3)) / F.greatest(F.size(words), F.lit(1))
    digits = F.regexp_count(name, F.lit(r"\d")) / F.greatest(F.length(name), F.lit(1))
    return F.when(F.size(words) == 0, 0.0).otherwise(0.8 * long + 0.2 * (1 - digits))


def text_density(text: Column) -> Column:
    """Share of non-empty lines that hold a price or columns set apart by spaces."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    hit = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"(?i)R?\s*[$]\s*\d[\d.,]*")) | F.regexp_like(x, F.lit(r"\s{3,}")))
    return F.when(F.size(lines) > 0, F.size(hit) / F.size(lines)).otherwise(0.0)


def price_display(value: Column, kind: str) -> Column:
    """A list or a map as text for display."""
    return F.array_join(value.cast("array<string>"), ", ") if kind.startswith("array") else F.to_json(value) if kind.startswith(("map", "struct")) else value.cast("string")


def extract_ppk(flat: Column, nested: Column) -> Column:
    """The first positive of the flat column and the nested one; else 0."""
    f, n = flat.try_cast("double"), nested.try_cast("double")
    return F.coalesce(F.when(f > 0, f), F.when(n > 0, n), F.lit(0.0))


def extract_pun(flat: Column, nested: Column) -> Column:
    """The same of prices per unit."""
    return extract_ppk(flat, nested)


def estimate_ppk(nested: Column, price: Column, unit: Column) -> Column:
    """Nested price per kg, else price over the weight read from the unit text (1 kg
    when there is none), else infinity."""
    number = lambda p, g: F.replace(_first(unit, p, g), F.lit(","), F.lit(".")).try_cast("double")
    three, two = r"(?i)(\d+)\s*x\s*([\d,.]+)\s*(kg|g)", r"(?i)([\d,.]+)\s*(kg|g)"
    kg = lambda w, p, g: w / F.when(F.lower(_first(unit, p, g)) == "kg", 1).otherwise(1000)
    total = (F.when(F.regexp_like(unit, F.lit(three)), number(three, 1) * kg(number(three, 2), three, 3))
             .when(F.regexp_like(unit, F.lit(two)), kg(number(two, 1), two, 2)).otherwise(1.0))
    return F.coalesce(nested, F.when(total > 0, price / total), F.lit(float("inf")))
