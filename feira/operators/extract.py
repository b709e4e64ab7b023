"""Semi-structured extraction as table jobs: flyer lines, product JSON, addresses,
number regions of read flyers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import kept
from .match import extract_brand
from .similar import spread

#: Words that make a flyer line no product line.
STOP_WORDS = ("somente", "sexta", "sábado", "sabado", "domingo", "estoque", "limitado", "limite", "unidade", "unidades", "cliente", "clientes", "cada", "preço",
              "preco", "promoção", "promocao", "confira", "apenas", "www", "http", "facebook", "instagram", "whatsapp", "telefone", "celular", "sac", "não", "nao",
              "nº", "numero", "número", "página", "pagina", "encarte", "folheto", "ofertas", "parcele", "cartão", "cartao", "crédito", "credito", "débito", "debito",
              "dinheiro", "total", "subtotal", "desconto", "economize", "condições", "condicoes", "geral")
#: Fixed value: a line that stands in the place of a product.
PLACEHOLDER = r"(?imu)^\s*lançamento\s*$"
#: Fixed values: (pattern, kind, confidence) of address clues.
ADDRESSES = (
    (r"(?iu)(?:R\.|Rua|Av\.|Avenida|Al\.|Alameda|Travessa|Trav\.|Praça|Pça\.|Estrada|Rodovia)\s+[^,;\n]+,\s*\d+\s*,?\s*[^,;\n]*", "rua_com_numero", 10.0),
    (r"(?iu)(?:R\.|Rua|Av\.|Avenida)\s+[^,;\n]+", "rua_sem_numero", 7.0),
    (r"(?iu)(?:CEP|Cep)\s*:?\s*\d{5}-?\d{3}", "cep", 8.0),
    (r"(?iu)(?:Fone|Tel|Telefone|WhatsApp|Whats|Zap|Contato)\s*:?\s*\(?\d{2}\)?\s*\d{4,5}-?\d{4}", "telefone", 5.0),
    (r"(?iu)(?:Bairro|Centro|Jardim|Vila\s+\w+|Parque\s+\w+|Residencial\s+\w+|Conjunto\s+\w+)", "bairro", 6.0),
    (r"(?iu)(?:Centro|Zona\s+(?:Sul|Norte|Leste|Oeste))\s*[-,]?\s*(?:Santos|São\s*Vicente|Praia\s*Grande|Mongaguá|Itanhaém|Peruíbe|Guarujá|São\s*Paulo)", "cidade_estado", 8.0),
)


def clean_line(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.trim(line), r"^\|+|\|+$", "")), r"\s+", " ")


def flyer_lines(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> id, pos, line: non-empty cleaned lines."""
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", clean_line(F.col("raw"))).filter("line <> ''").drop("raw")


def distinct_lines(texts: DataFrame) -> DataFrame:
    """The same without repeats of a line in its text, whatever the case; first kept."""
    f = flyer_lines(texts).groupBy("id", F.lower("line").alias("key")).agg(F.min(F.struct("pos", "line")).alias("f"))
    return f.select("id", "f.pos", "f.line")


def parse_flyer_lines(lines: DataFrame, ascii_words: bool = False) -> DataFrame:
    """lines (id, pos, line) -> product rows (id, pos, product, price, unit,
    validity_raw).

    Name lines gather until a price line closes the product. A validity line counts
    for the next product that comes out (a name of more than 3 characters); the
    buffer is emptied by every price line. Validity lines are seen first, then stop
    lines, then prices. Windows run within one text only. ascii_words: words of prices and
    units end at letters that ASCII lacks, as in engines whose word boundary knows no others.
    """
    low = F.lower("line")
    stop = F.size(F.array_intersect(F.split(low, r"\s+"), F.array(*[F.lit(w) for w in STOP_WORDS]))) > 0
    x = lines.withColumn("validity", F.nullif(T.extract_validity(F.col("line")), F.lit("")))
    x = x.withColumn("stop", F.col("validity").isNull() & (stop | (F.length("line") < 3) | F.regexp_like("line", F.lit(r"^\d+$"))))
    x = x.filter("not stop").withColumn("price", F.when(F.col("validity").isNull(), T.extract_price_brl(F.col("line"), ascii_words)))
    w = Window.partitionBy("id").orderBy("pos")
    x = x.withColumn("island", F.count("price").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rest = F.when(F.col("price").isNotNull(), F.trim(F.regexp_replace("line", T.price_pattern(ascii_words), ""))).when(F.col("validity").isNull(), F.col("line"))
    x = x.withColumn("part", F.nullif(rest, F.lit("")))
    g = x.groupBy("id", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("pos", "part")))), lambda s: s["part"]), " ").alias("product"),
        F.max("price").alias("price"), F.max(F.when(F.col("price").isNotNull(), F.col("pos"))).alias("pos"), F.max_by("validity", F.when(F.col("validity").isNotNull(), F.col("pos"))).alias("validity"))
    g = g.filter("price is not null").withColumn("product", F.trim(F.regexp_replace("product", r"\s+", " "))).withColumn("out", F.length("product") > 3)
    # a validity waits over islands that give no product
    wi = Window.partitionBy("id").orderBy("island")
    g = g.withColumn("turn", F.coalesce(F.sum(F.col("out").cast("int")).over(wi.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("held", F.last("validity", ignorenulls=True).over(Window.partitionBy("id", "turn").orderBy("island").rowsBetween(Window.unboundedPreceding, 0)))
    return g.filter("out").select("id", "pos", "product", "price", T.extract_unit(F.col("product"), ascii_words).alias("unit"), F.coalesce("held", F.lit("")).alias("validity_raw"))


def _get(v, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or NUMBER; null where nothing is."""
    k = F.substring_index(F.substring_index(F.schema_of_variant(v), "(", 1), "<", 1)
    return F.when(k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(k)


def _holds(v: Column) -> Column:
    """Is a JSON value there, and not null, false, zero or empty?"""
    text = F.to_json(v)
    return F.coalesce(F.when(_kind(v) == "NUMBER", _get(v, "$", "double") != 0).otherwise(~text.isin("null", "false", '""', "[]", "{}")), F.lit(False))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _once(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of v, which is worked out once, however often f names it."""
    return F.get(F.transform(F.array(v), f), 0)


def _each(rows: DataFrame, array: Column, name: str, *others: str | Column) -> DataFrame:
    """A row for each element that is there."""
    return rows.select(*others, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def jsonld_products(pages: DataFrame) -> DataFrame:
    """pages (id, html) -> id, name, price, unit of the items of JSON-LD item lists: the
    low price unless it is absent or zero, else the price; numbers above 0 only. An item
    without a name or a price is passed over, as is one with a line that is only the
    placeholder. One of another shape (a string for a price, a list of offers) ends its
    block, the items before it stay. A block that is no JSON object gives nothing."""
    block = F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<script\s+type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1)))
    other = lambda v, kind: F.coalesce(_kind(v) != kind, F.lit(False))

    once = _once

    def item(e: Column) -> Column:
        return once(F.struct(e.alias("e"), _get(e, "$.item").alias("x")), parts)

    def parts(i: Column) -> Column:
        x = i["x"]
        fields = F.struct(_get(x, "$.name").alias("name"), _get(x, "$.offers").alias("offers"), _get(x, "$.offers.lowPrice").alias("low"), (other(i["e"], "OBJECT") | other(x, "OBJECT")).alias("bad"))
        return once(fields, lambda f: once(F.struct(f.alias("f"), F.when(_holds(f["low"]), f["low"]).otherwise(_get(f["offers"], "$.price")).alias("price")), lambda p: checked(p["f"], p["price"])))

    def checked(f: Column, price: Column) -> Column:
        name = f["name"]
        bad = f["bad"] | (_holds(name) & (other(name, "STRING") | other(f["offers"], "OBJECT") | (_holds(price) & other(price, "NUMBER"))))
        return F.struct(bad.alias("bad"), F.when(_holds(name), _strip(_get(name, "$", "string"))).alias("name"), F.when(_kind(price) == "NUMBER", _get(price, "$", "double")).alias("price"))

    j = pages.select("id", block.alias("block")).withColumn("j", F.try_parse_json(F.trim("block"))).filter(_get(F.col("j"), "$['@type']", "string") == "ItemList")
    x = j.select("id", F.transform(_get(F.col("j"), "$.itemListElement", "array<variant>"), item).alias("items"))
    end = F.array_position(F.transform("items", lambda i: i["bad"]), True)
    x = x.select("id", F.explode(F.when(end > 0, F.slice("items", 1, (end - 1).cast("int"))).otherwise(F.col("items"))).alias("i")).select("id", "i.name", "i.price")
    return x.filter("name <> '' and price > 0").filter(~F.regexp_like("name", F.lit(PLACEHOLDER))).withColumn("unit", T.extract_unit(F.col("name")))


def shopify_products(responses: DataFrame) -> DataFrame:
    """responses (id, json) -> id, name, brand, price, variant, unit: the first variant
    that is available (or doesn't say), else the first; positive prices, as numbers or
    as strings, and titles that are not blank only."""
    def product(p: Column) -> Column:
        variants = _get(p, "$.variants", "array<variant>")
        free = lambda e: _once(_get(e, "$.available"), lambda a: a.isNull() | _holds(a))
        return _once(variants, lambda vs: _once(F.coalesce(F.get(F.filter(vs, free), 0), F.get(vs, 0)), lambda v: F.struct(
            _strip(_get(p, "$.title", "string")).alias("name"), _strip(F.coalesce(_get(p, "$.vendor", "string"), F.lit(""))).alias("brand"),
            F.trim(_get(v, "$.price", "string")).try_cast("double").alias("price"), _get(v, "$.title", "string").alias("variant"))))

    found = F.transform(_get(F.try_parse_json("json"), "$.products", "array<variant>"), product)
    x = _each(responses, F.filter(found, lambda p: (p["name"] != "") & (p["price"] > 0)), "p", "id")
    return x.select("id", "p.name", "p.brand", "p.price", "p.variant").withColumn("unit", T.extract_unit(F.col("name")))


def vtex_offers(responses: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """responses (id, json array of products; with a catalog: ingredient, what was asked
    for) -> a row for each seller's offer with a positive price and stock: name (the
    item's complete name, its name, or the product's), brand (the ingredient's that the
    name holds, else the declared one), unit, validity_raw, seller, price, quantity."""
    def held(v: Column, path: str) -> Column:
        """The text of a value that is not null, false, zero or empty."""
        sure = lambda t: (t != "") & ~F.substring(t, 1, 1).isin("0", "-", "f")  # noqa: E731 (most are; no kind is looked up for them)
        return _once(_get(v, path, "string"), lambda t: F.when(sure(t), t).when(t.isNotNull() & _holds(_get(v, path)), t))

    def offer(s: Column) -> Column:
        return _once(_get(s, "$.commertialOffer"), lambda o: F.struct(
            _get(s, "$.sellerName", "string").alias("seller"), _once(_get(o, "$.Price"), lambda p: F.when(_kind(p) == "NUMBER", _get(p, "$", "double"))).alias("price"),
            _get(o, "$.AvailableQuantity", "long").alias("quantity"), F.coalesce(_get(o, "$.priceValidUntil", "string"), F.lit("")).alias("validity_raw")))

    asked, p, i = ["ingredient"] if catalog is not None else [], F.col("p"), F.col("i")
    x = _each(responses, _get(F.try_parse_json("json"), "$", "array<variant>"), "p", "id", *asked)
    x = _each(x, _get(p, "$.items", "array<variant>"), "i", "id", *asked, "p")
    x = x.select("id", *asked, F.coalesce(held(i, "$.nameComplete"), held(i, "$.name"), held(p, "$.productName"), F.lit("")).alias("name"), F.coalesce(_get(p, "$.brand", "string"), F.lit("")).alias("brand"), i)
    unit = T.extract_unit(F.col("name"))
    if catalog is None:
        x = x.withColumn("unit", unit)
    else:  # brand and unit of each name, once
        named = extract_brand(kept(x.select(F.col("name").alias("raw_product"), "ingredient").distinct(), "names"), catalog, default=None)
        named = kept(named.select(F.col("raw_product").alias("name"), F.col("ingredient").alias("of"), F.col("brand").alias("held")).withColumn("unit", unit), "named")
        x = x.join(named, (x["name"] == named["name"]) & x["ingredient"].eqNullSafe(named["of"]), "left").select("id", x["name"], F.coalesce("held", "brand").alias("brand"), "unit", "i")
    offers = F.transform(_get(F.col("i"), "$.sellers", "array<variant>"), offer)
    x = _each(x, F.filter(offers, lambda o: (o["price"] > 0) & (o["quantity"] > 0)), "o", "id", "name", "brand", "unit")
    return x.select("id", "name", "brand", "o.seller", "o.price", "o.quantity", "o.validity_raw", "unit")


def extract_addresses(texts: DataFrame) -> DataFrame:
    """texts (id, text) with addresses: (address, confidence, kind), distinct by their
    folded text (the first kind that found it), best first."""
    def clues(pattern: str, kind: str, confidence: float) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.struct(F.trim(m).alias("address"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind")))

    found = F.flatten(F.array(*[clues(*a) for a in ADDRESSES]))
    keyed = F.transform(found, lambda x: F.regexp_replace(F.lower(x["address"]), r"\s+", " "))
    t = texts.withColumn("_f", F.coalesce(found, F.array().cast("array<struct<address:string,confidence:double,kind:string>>"))).withColumn("_k", F.coalesce(keyed, F.array().cast("array<string>")))
    first = F.filter("_f", lambda x, i: F.array_position("_k", F.get(F.col("_k"), i)) == i + 1)
    order = F.array_sort(F.transform(first, lambda x, i: F.struct((-x["confidence"]).alias("o"), i.alias("i"), x.alias("x"))))
    return t.withColumn("addresses", F.transform(order, lambda s: s["x"])).drop("_f", "_k")


def best_address(extracted: DataFrame) -> DataFrame:
    """With address, confidence and kind: the best of confidence 7 and more, else the
    first three joined when there are two or more, else null."""
    a, top = F.col("addresses"), F.slice("addresses", 1, 3)
    one, many = F.get(a, 0)["confidence"] >= 7, F.size(a) >= 2
    mean = F.round(F.aggregate(top, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(top), 2)
    return extracted.withColumns({"address": F.when(one, F.get(a, 0)["address"]).when(many, F.array_join(F.transform(top, lambda x: x["address"]), "; ")),
                                  "confidence": F.when(one, F.get(a, 0)["confidence"]).when(many, mean), "kind": F.when(one, F.get(a, 0)["kind"]).when(many, "combinado")})


def name_from_texts(texts: Column) -> Column:
    """Texts longer than one character joined, at most 80 characters."""
    return F.substring(F.array_join(F.filter(texts, lambda t: F.length(F.trim(t)) > 1), " "), 1, 80)


# Number regions: one read flyer is one bounded group (a page of print).

_NUMBER = re.compile(r"[R$\s]*(\d[\d.,]*)\s*")


@lru_cache(100_000)
def _number(text: str) -> tuple[str, str, float | None] | None:
    """A text that is a number, without blanks at its ends, its digits, and its value if
    it has a separator and three digits or more."""
    raw = text.strip()
    m = _NUMBER.fullmatch(raw)
    if m is None:
        return None
    d = re.sub("[.,]", "", m[1])
    if ("," not in raw and "." not in raw) or len(d) < 3:
        return raw, d, None
    whole, _, part = raw.replace(".", ",").rpartition(",")
    whole, part = ("".join(c for c in t if c.isdigit()) for t in (whole, part))
    return raw, d, int(whole or "0") + int((part + "00")[:2]) / 100


def _prices(texts: list[str | None], cx: list[float], cy: list[float], heights: list[float], least_height: float) -> list[tuple[float, float, float, str]]:
    """(value, cx, cy, how) of one flyer; a cents region serves one price."""
    n = [(-h, x, y, *found) for text, x, y, h in zip(texts, cx, cy, heights) if text is not None and (found := _number(text)) is not None]
    n.sort()  # tallest first
    used: set[int] = set()
    out = []
    cents = sorted((x[1], k) for k, x in enumerate(n) if len(x[4]) == 2)
    for i, (h, cx_, cy_, _, d, value) in enumerate(n):
        if i in used:
            continue
        h = -h
        if value is not None:
            how = "sep"
        elif h > 60 and len(d) in (3, 4):
            value, how = int(d[:-2]) + int(d[-2:]) / 100, f"blob{len(d)}"
        elif h > least_height and len(d) <= 2:
            value, how = float(d), "no_cents"
            near = None
            for at in range(bisect_right(cents, (cx_, len(n))), len(cents)):  # to the right of it
                x, k = cents[at]
                if x - cx_ >= 2 * h:
                    break
                dx, dy = x - cx_, abs(n[k][2] - cy_)
                if k != i and k not in used and dx > 0 and dy < 0.9 * h and -n[k][0] < h and (near is None or (dx + dy, k) < near):
                    near = (dx + dy, k)
            if near:
                k = near[1]
                used.add(k)
                value, how = int(d) + int(n[k][4]) / 100, "cents"
        else:
            continue
        used.add(i)
        out.append((value, cx_, cy_, how))
    return out


def _dedup(prices: list[tuple], dx: float, dy: float) -> list[tuple]:
    """The lowest of the prices that stand together in a column."""
    left, out = sorted(prices, key=lambda p: (p[1], p[2])), []
    gone = [False] * len(left)
    for k, p in enumerate(left):
        if gone[k]:
            continue
        best = p
        for j in range(k, len(left)):
            q = left[j]
            if q[1] - p[1] > dx:
                break
            if not gone[j] and abs(q[2] - p[2]) <= dy:
                gone[j] = True
                best = min(best, q, key=lambda q: q[0])
        out.append(best)
    return out


def _mean(at: int) -> Column:
    """The mean of a coordinate over the points of `box`; of four points outright."""
    four = reduce(lambda a, b: a + b, [F.get(F.get("box", k), at) for k in range(4)]) / 4
    return F.when(F.size("box") == 4, four).otherwise(F.aggregate("box", F.lit(0.0), lambda s, p: s + p[at]) / F.size("box"))


def _height() -> Column:
    """From the least to the largest y of `box`."""
    y = [F.get(F.get("box", k), 1) for k in range(4)]
    ys = F.transform("box", lambda p: p[1])
    return F.when(F.size("box") == 4, F.greatest(*y) - F.least(*y)).otherwise(F.array_max(ys) - F.array_min(ys))


def _listed(column: pa.Array) -> list:
    """The values of a column; those that come again are made once."""
    if pa.types.is_floating(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    d = column.dictionary_encode()
    values = [*d.dictionary.to_pylist(), None]
    return [values[k] for k in d.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]


def _median(values: list[float]) -> float:
    v, k = sorted(values), len(values) // 2
    return v[k] if len(v) % 2 else (v[k - 1] + v[k]) / 2


def _by_flyer(regions: DataFrame, run: Callable[[list, list, list, list], list[tuple]], schema: str, types: list[pa.DataType], dealt: bool) -> DataFrame:
    """flyer_id and the rows that `run` makes of a flyer's regions: texts, centres and
    heights. Four slim columns move, sorted by flyer; no box does. dealt: what made the
    regions (a window, a join) has brought those of a flyer together, so none moves."""
    slim = regions.select("flyer_id", "text", _mean(0).alias("x"), _mean(1).alias("y"), _height().alias("h"))
    names = [c.split()[0] for c in schema.split(", ")]

    def flyers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None  # the flyer that may go on in the next batch
        for batch in batches:
            out = []
            ends = pc.run_end_encode(batch.column("flyer_id")) if batch.num_rows else None
            cols, start = [_listed(batch.column(c)) for c in ("text", "x", "y", "h")], 0
            for flyer, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()) if ends is not None else ():
                part = [c[start:end] for c in cols]
                if own is not None and own[0] == flyer:
                    part = [a + b for a, b in zip(own[1], part)]
                elif own is not None:
                    out += [(own[0], *r) for r in run(*own[1])]
                own, start = (flyer, part), end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if own is not None and (out := [(own[0], *r) for r in run(*own[1])]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    if dealt:  # a window moves only what is not together yet; its rank is sent along, as Spark drops it else
        together = slim.withColumn("_", F.row_number().over(Window.partitionBy("flyer_id").orderBy(F.desc("h"), "x", "y")))
    else:
        together = spread(slim, "flyer_id").sortWithinPartitions("flyer_id")
    return together.mapInArrow(flyers, schema)


_PRICED = "flyer_id string, price double, cx double, cy double, how string"
_PRICED_TYPES = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]


def region_prices(regions: DataFrame, least_height: float = 55.0, dedup: bool = False, max_dx: float = 70.0, max_dy: float = 170.0, dealt: bool = False) -> DataFrame:
    """regions (flyer_id, text, box, score) -> flyer_id, price, cx, cy, how; with dedup
    the two prices that a product shows become the lower one (dual_price_dedup). dealt: see _by_flyer."""
    def run(texts: list, cx: list, cy: list, heights: list) -> list[tuple]:
        rows = _prices(texts, cx, cy, heights, least_height)
        return _dedup(rows, max_dx, max_dy) if dedup else rows

    # only regions with a digit can be numbers
    return _by_flyer(regions.filter(F.regexp_like("text", F.lit("[0-9]"))), run, _PRICED, _PRICED_TYPES, dealt)


def dual_price_dedup(regions: DataFrame, **params) -> DataFrame:
    return region_prices(regions, dedup=True, **params)


def box_join(prices: DataFrame, regions: DataFrame, dx: float | Column = 260.0, above: float | Column = 320.0, below: float | Column = 40.0) -> DataFrame:
    """Pairs of a price and a text region of the same flyer near it; the bounds may be
    columns of prices."""
    r = regions.select("flyer_id", F.col("text").alias("name_text"), _mean(0).alias("tx"), _mean(1).alias("ty"))
    near = (F.abs(F.col("tx") - F.col("cx")) < dx) & (F.col("ty") - F.col("cy") > -above) & (F.col("ty") - F.col("cy") < below)
    return prices.join(r, "flyer_id").filter(near)


#: Texts near a price that are no product name.
PROMO_TEXT = "(?i)" + "|".join((
    r"cliente\s*(?:app|cartao)?", r"limite\s*por\s*cpf", r"descontou?\s*", r"pagando\s*com\s*o", r"cart[aã]o\s*tenda", r"v[aá]lida\s*para", r"imagens\s*meramente", r"promo[cç][aã]o\s*v[aá]lida",
    r"ofertas\s*v[aá]lidas", r"enquanto\s*durarem", r"beber?\s*com\s*modera[cç][aã]o", r"venda\s*proibida\s*para\s*menores", r"aleitamento\s*materno", r"art\.?\s*\d+.*estatuto",
    r"220v?\s*somente\s*nas\s*lojas", r"s[aã]o\s+jos[eé]\s+dos\s+campos", r"leve\s+\d+\s*pague\s*\d+", r"leve\s+\d+\s*e\s*pague\s*\d+"))


#: Phrases of offers and packages that are no product name.
BOILERPLATE = "(?iu)" + "|".join((
    "limite por cpf", "desconto", "cliente app", "cll?ente", "cart[aã]o tenda", "com o cart", "pagando com", r"pre[cç]o(\s|$)", "sai por", "^tenda$", "^atacado$", "fecha", "na loja", "no site", "no app",
    r"unidades?\.?$", r"quilos?\.?$", r"packs?\.?$", r"bandejas?\.?$", "^cada$", "^o kg$", "^a unidade$", "v[aá]lidas? para", "ofertas?", r"^pe[cç]a\b", r"^pacote\b", r"^lata\b", r"^garrafa\b",
    r"^sache\b", r"^sab?ores?\b", "^o bife", "^o peda[cç]o", "^o litro", "^o pote", "^a bandeja", "^embalagem", "desde"))


def is_product_name(text: Column) -> Column:
    """Four letters at least, more than half of the text, and no boilerplate."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return (letters >= 4) & (letters / F.greatest(F.length(t), F.lit(1)) > 0.5) & ~F.regexp_like(t, F.lit(BOILERPLATE))


def clustering_params(profile: DataFrame) -> DataFrame:
    """Layout profiles with the parameters of their blocks: gap, x_gap, block_dx,
    above, below, most. Many columns narrow them, wide rows lengthen them, dense pages
    and small print shrink them, sparse pages and large print widen them."""
    between = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    many, rows, dense, sparse = F.col("columns") > 4, F.col("row_gap") > 0, F.col("density") > 100, F.col("density") < 20
    small, large = F.col("text_height") < 15, F.col("text_height") > 30
    p = profile.withColumns({
        "gap": F.when(rows, between(F.col("row_gap") * 0.8, 30.0, 80.0)).otherwise(50.0),
        "x_gap": F.when(many, F.greatest(F.lit(150.0), 1000.0 / F.col("columns"))).otherwise(250.0),
        "block_dx": F.when(many, F.least(F.lit(300.0), 200.0 + 50.0 * F.col("columns"))).otherwise(260.0),
        "above": F.when(rows, between(F.col("row_gap") * 2.5, 200.0, 400.0)).otherwise(320.0), "below": F.lit(40.0),
        "most": F.when(dense, 4).when(sparse, 8).otherwise(6)})
    p = p.withColumns({"gap": F.when(dense, F.greatest(F.lit(30.0), F.col("gap") * 0.7)).when(sparse, F.least(F.lit(100.0), F.col("gap") * 1.3)).otherwise(F.col("gap")),
                       "x_gap": F.when(dense, F.greatest(F.lit(150.0), F.col("x_gap") * 0.8)).otherwise(F.col("x_gap"))})
    return p.withColumns({"gap": F.when(small, F.greatest(F.lit(20.0), F.col("gap") * 0.8)).when(large, F.least(F.lit(100.0), F.col("gap") * 1.2)).otherwise(F.col("gap")),
                          "x_gap": F.when(small, F.greatest(F.lit(100.0), F.col("x_gap") * 0.8)).when(large, F.least(F.lit(400.0), F.col("x_gap") * 1.2)).otherwise(F.col("x_gap"))})


def price_blocks(regions: DataFrame, adapt: bool = True, dealt: bool = False) -> DataFrame:
    """flyer_id, price, texts: each price with the product names that belong to it: near
    it, no promotion text, within a gap of the lowest of them, and of the columns that
    x gaps part the one with the most texts (ties to the nearest). The bounds follow
    the layout of the flyer, or are those of an unknown one (adapt False)."""
    names = regions.filter(is_product_name(F.col("text")) & ~F.regexp_like("text", F.lit(PROMO_TEXT)))
    if adapt:
        prices = clustering_params(_profiled_prices(regions, dealt)).select("flyer_id", "price", "cx", "cy", "gap", "x_gap", "block_dx", "above", "below", "most")
    else:
        prices = region_prices(regions, dedup=True, dealt=dealt).withColumns({k: F.lit(v) for k, v in {"gap": 50.0, "x_gap": 250.0, "block_dx": 260.0, "above": 320.0, "below": 40.0, "most": 6}.items()})
    j = box_join(prices, names, F.col("block_dx"), F.col("above"), F.col("below"))
    key = ["flyer_id", "price", "cx", "cy", "most"]
    j = j.withColumn("base", F.max("ty").over(Window.partitionBy(*key))).filter(F.col("base") - F.col("ty") < F.col("gap"))
    w = Window.partitionBy(*key).orderBy("tx", "ty", "name_text")
    j = j.withColumn("new", (F.col("tx") - F.lag("tx").over(w) > F.col("x_gap")).cast("int")).withColumn("col", F.sum(F.coalesce("new", F.lit(0))).over(w))
    g = j.groupBy(*key, "col").agg(F.count("*").alias("n"), F.abs(F.avg("tx") - F.first("cx")).alias("far"), F.array_sort(F.collect_list(F.struct("ty", "tx", "name_text"))).alias("t"))
    best = g.groupBy(*key).agg(F.max_by("t", F.struct("n", -F.col("far"))).alias("t"))
    texts = F.transform("t", lambda s: s["name_text"])
    return best.select("flyer_id", F.round("price", 2).alias("price"), F.slice(texts, F.greatest(F.size("t") - F.col("most") + 1, F.lit(1)), F.col("most")).alias("texts"))


_LAYOUT = "region_count long, text_height double, price_count int, columns int, col_gap double, row_gap double"
_LAYOUT_TYPES = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]


def _layout(prices: list[tuple], heights: list[float | None]) -> tuple:
    """The columns of _LAYOUT of a flyer, from its prices and the heights of its regions."""
    tall = [h for h in heights if h is not None]
    xs: list[float] = []
    for x in sorted(p[1] for p in prices):
        if not xs or x - xs[-1] > 80:
            xs.append(x)
        else:
            xs[-1] = (xs[-1] + x) / 2
    rows = [b - a for a, b in pairwise(sorted(p[2] for p in prices)) if b - a > 50]
    gaps = (_median([b - a for a, b in pairwise(xs)]) if len(xs) > 1 else 0.0, _median(rows) if rows else 150.0) if prices else (0.0, 0.0)
    return (len(heights), _median(tall) if tall else 0.0, len(prices), len(xs), *gaps)


def _digits_only(regions: DataFrame) -> DataFrame:
    """All regions; texts without a digit count, but don't move."""
    return regions.withColumn("text", F.when(F.regexp_like("text", F.lit("[0-9]")), F.col("text")))


def _profiled(x: DataFrame) -> DataFrame:
    """The columns of _LAYOUT with density and type of the flyer."""
    x = x.withColumn("density", F.col("price_count") / F.greatest(F.col("region_count"), F.lit(1)) * 1000)
    n, c, d = F.col("region_count"), F.col("columns"), F.col("density")
    kind = (F.when(F.col("price_count") == 0, "unknown").when((n > 500) & (c >= 3) & (n / F.greatest(F.col("price_count"), F.lit(1)) > 15), "tenda_grid_4col").when((n > 350) & (c >= 3), "roldao_dense_grid")
            .when((n < 150) & (d > 80), "atacadao_sparse").when(d < 30, "sparse_catalog").otherwise("unknown"))
    return x.withColumn("flyer_type", kind)


def layout_profile(regions: DataFrame, dealt: bool = False) -> DataFrame:
    """Per flyer: regions, prices, columns, gaps, density, median text height and type."""
    def run(texts: list, cx: list, cy: list, heights: list) -> list[tuple]:
        return [_layout(_dedup(_prices(texts, cx, cy, heights, 55.0), 70.0, 170.0), heights)]

    # regions are read once
    return _profiled(_by_flyer(_digits_only(regions), run, "flyer_id string, " + _LAYOUT, [pa.string(), *_LAYOUT_TYPES], dealt))


def _profiled_prices(regions: DataFrame, dealt: bool) -> DataFrame:
    """region_prices with dedup, each beside the layout of its flyer: regions are read once."""
    def run(texts: list, cx: list, cy: list, heights: list) -> list[tuple]:
        prices = _dedup(_prices(texts, cx, cy, heights, 55.0), 70.0, 170.0)
        layout = _layout(prices, heights) if prices else ()
        return [p + layout for p in prices]

    return _profiled(_by_flyer(_digits_only(regions), run, _PRICED + ", " + _LAYOUT, [*_PRICED_TYPES, *_LAYOUT_TYPES], dealt))
