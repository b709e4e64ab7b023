"""Mixing sources to target weights by Pareto order sampling, in DataFrame
operations only.

Every source gets a target number of words. Whole copies that are certain are
allocated first; what is left of the target is drawn by Pareto sampling, with
inclusion probabilities in proportion to size: those of a source's documents add up
to what is left, and a document whose share would pass 1 is certain. Each document
has a fixed random number u; its odds u/(1-u) are divided by the odds of its
inclusion, and the documents with the smallest quotients are taken until the words
are used up. The sample's size is fixed in words, so the mix meets its target to
within half a document.

The rank is not computed by sorting a source in one task: quotients are dealt to
bins, words are summed by (source, bin), and only documents of the one bin in
which the target falls are ordered. There, rows that are equal are one group with a
count, of which part may be taken: first those of the first parts of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, with_columns

WEIGHTS = (3, 1, 2)
BINS = 65_536


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> source, source_size, w, target.

    Sources by code point, null last, weigh 3, 1, 2, repeating. The target is
    share times all words by weight, but at most `most` times the source's size;
    the excess is dealt again by weight among the others until none is above.
    The fixed point is closed: with sources ordered by size over weight, those
    before some place are full, so it is one cumulative sum over the sources'
    table (one row a source) in place of a loop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.withColumn("k", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    budget = F.lit(share) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("fits", F.col("cap") / F.col("w") <= level).withColumn("level", level)
    # all sources up to the last that fits are full; the others share the first level at which one does not fit
    rest = F.min(F.when(~F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("k"), F.col("level")))).over(whole)
    return (s.withColumn("rest", rest["level"])
            .select("source", "source_size", "w",
                    F.when(F.col("fits"), F.col("cap")).otherwise(F.col("rest") * F.col("w")).alias("target")))


def uniform(doc_id: Column, text: Column) -> Column:
    """A fixed number in (0, 1) for each id and text, from their MD5: reruns agree,
    and rows that only share an id have numbers of their own."""
    both = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(both), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def rates(d: DataFrame, t: DataFrame) -> DataFrame:
    """(source, size) of the documents, (source, want) -> source, c: with inclusion
    probabilities of least(1, c * size) a source's words are expected to be `want`.

    Sizes are folded to a histogram, largest first: if all above some size are
    certain, the others share what is left by the sum of their squares.
    """
    hist = d.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).alias("h")
    hist = hist.join(t.select("source", "want").alias("t"), F.expr("h.source <=> t.source")).select("h.source", "size", "n", "want")
    big = F.col("size").cast("decimal(20,0)")
    w = Window.partitionBy("source").orderBy(F.desc("size"))
    before = F.coalesce(F.sum(big * F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    squares = F.sum((F.col("size") * F.col("size")).cast("decimal(20,0)") * F.col("n")).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    c = hist.withColumn("c", (F.col("want") - before) / squares).filter(F.col("c") * F.col("size") <= 1)
    return c.groupBy("source").agg(F.max_by("c", "size").alias("c"))


def _equal(left: str, right: str, columns: tuple[str, ...]) -> Column:
    return F.expr(" and ".join(f"{left}.{c} <=> {right}.{c}" for c in columns))


def _edge(edge: DataFrame) -> DataFrame:
    """extra (0 or 1) of the rows in their source's cut bin, of which `before` words
    come before: those whose middle is within `want`, in the order of the quotient."""
    same = ("source", "q", "doc_id", "size")
    groups = edge.groupBy(*same, "want", "before").agg(F.count("*").alias("m"))
    run = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("m") * F.col("size")).over(run), F.lit(0))
    take = F.floor((F.col("want") - start) / F.col("size") + 0.5)
    groups = groups.withColumn("take", F.least(F.col("m"), F.greatest(F.lit(0), take))).select(*same, "m", "take")
    rows = edge.alias("e").join(groups.alias("g"), _equal("e", "g", same)).select("e.*", "m", "take")
    whole = rows.filter("take = 0 or take = m").withColumn("extra", (F.col("take") > 0).cast("long"))
    # of equal rows, number those of each part of the input, after those of the parts before
    cut = rows.filter("take > 0 and take < m").withColumn("part", F.shiftrightunsigned("row", 33))
    sizes = cut.groupBy(*same, "part").agg(F.count("*").alias("k"))
    order = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("k").over(order), F.lit(0))).drop("k")
    number = F.row_number().over(Window.partitionBy(*same, "part").orderBy("row"))
    cut = (cut.withColumn("number", number).alias("e").join(sizes.alias("g"), _equal("e", "g", (*same, "part"))).select("e.*", "earlier")
           .withColumn("extra", (F.col("earlier") + F.col("number") <= F.col("take")).cast("long")).drop("part", "number", "earlier"))
    return whole.unionByName(cut).drop("m", "take")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies,
    source, u (the row's random number).

    Each document gets floor(target / source_size) whole copies, and at most one
    more by Pareto sampling; so taken is a multiple of size and never above `most`
    times it (most a whole number). Nulls: a null text has size 0, a null source is
    a source of its own, ordered last, a null doc_id draws the number of an empty
    id. Documents of no word are never drawn (they add none). Ties in the quotient
    go by doc_id, then by size; of rows equal in all of these as many are taken as
    fit. A source of 0 words has target 0. An empty table gives no rows; extra
    columns are ignored.
    """
    d = with_columns(docs, {"doc_id": "long", "text": "string", "source": "string"})
    d = d.select("doc_id", "source", word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u"))
    d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "sizes")
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    t = t.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    t = materialize(t.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    t = t.alias("t").join(rates(d, t).alias("r"), F.expr("t.source <=> r.source"), "left").select("t.*", "c")
    t = materialize(t, "rates")
    on = F.expr("d.source <=> t.source")
    pi = F.least(F.lit(1.0), F.col("c") * F.col("size"))
    q = F.when((F.col("size") > 0) & (pi >= 1), 0.0).when((F.col("size") > 0) & (pi > 0), (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi)))
    d = d.alias("d").join(t.alias("t"), on).select("row", "d.doc_id", "d.source", "d.size", "u", "t.source_size", "t.target", "t.whole", "t.want", q.alias("q"))
    # q/(1+q) is in (0, 1) and keeps the order
    d = d.withColumn("bin", F.when(F.col("q").isNotNull(), F.floor(F.col("q") / (1 + F.col("q")) * BINS)))
    bins = d.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("want").alias("want"))
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cut = (bins.withColumn("upto", upto).filter("upto >= want").groupBy("source")
           .agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before")), "bin").alias("c"))
           .select("source", F.col("c.bin").alias("cut_bin"), F.col("c.before").alias("before")))
    cut = materialize(cut, "cut")
    d = d.alias("d").join(cut.alias("t"), on, "left").select("d.*", "cut_bin", "before")
    edge = F.col("cut_bin").isNotNull() & (F.col("bin") == F.col("cut_bin"))
    rest = d.filter(~edge | edge.isNull()).withColumn("extra", F.coalesce(
        (F.col("bin") < F.coalesce("cut_bin", F.lit(BINS + 1))).cast("long"), F.lit(0)))
    copies = F.col("whole") + F.col("extra")
    return rest.unionByName(_edge(d.filter(edge))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("long").alias("copies"), "source", "u")
