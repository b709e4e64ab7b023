"""Similarity join of names by token sets, exact at any threshold.

`score` is the token-set similarity of two cleaned names (see similarity.py). A pair
of that score has grams (stretches of q letters) in common. Grams are taken within
words and at their ends, so they don't depend on the order of words: a name of n
characters and w words has n + 1 of two letters, or n + 1 - w of three. With s the
characters of both names,

- names that are alike as a whole share at least s * least / 200 - (q - 1) * (1 + s *
  (1 - least / 100)), as the common subsequence has least * s / 200 characters, and
  each of the other characters breaks q - 1 grams at most;
- of a name of which most is in the other (the common words, then the same words with
  others), least / (200 - least) of the characters are in the other, with their grams.

(Of three letters, those across a space are not counted, w - 1 at most.) So the
shorter name, or the one that is mostly inside, must meet the other on one of its
rarest grams, few enough that the rest can't reach the bound. Where a name's bound is
below one gram (short names, low thresholds) it is held against all others in blocks
instead (similar.py).

Names that only differ in a digit share all but their rarest grams, so grams are left to
long names. Of the others,

- a name that is mostly inside the other meets it on one of its rarest words, as many as
  the common words can't do without (`by_words`);
- names alike as a whole have equal words and, of the rest, a common subsequence from
  which both are few letters away: they meet on what is left without so many letters
  (`by_letters`). The letters that either side lacks are part of the key, so nearly all
  that meet are similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import _token_set_ratio
from ..sources.work import work_path
from .similar import BLOCK_TERMS, similar_terms, spread

#: Most keys of letters that a name may have; longer ones meet by grams.
LETTER_KEYS = 2_000


def gram_length(least: float) -> int:
    """Three letters where the threshold leaves enough of them whole, else two."""
    return 3 if least >= 90 else 2


def prepared(names: DataFrame, least: float) -> DataFrame:
    """Distinct names (name) with their grams, numbered where one occurs again, and
    needed: how many of these a name has in common with any that it must meet as the
    shorter one, or as the one mostly inside the other."""
    q = gram_length(least)
    d = names.filter(F.trim("name") != "").distinct().withColumn("words", F.array_distinct(F.filter(F.split("name", " "), lambda w: w != "")))
    d = d.withColumn("size", F.length(F.array_join("words", " ")))
    pad = F.transform("words", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    d = d.withColumn("found", F.flatten(F.transform(pad, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - q + 1), lambda i: F.substring(w, i, F.lit(q))))))
    alike = 2 * F.col("size") * (least / 200 - (q - 1) * (1 - least / 100)) - (q - 1)
    inside = F.col("size") * (least / (200 - least)) + (1 if q == 2 else 0)
    across = F.size("words") - 1 if q == 3 else F.lit(0)
    # the letters that it may lack, and a bound on the texts without so many
    rate = 1 - least / 100
    d = d.withColumn("lacks", F.floor(2 * rate / (1 + rate) * F.col("size") + 1e-6))
    ways = F.aggregate(F.sequence(F.lit(0), F.least("lacks", F.lit(20))), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("n")),
                       lambda s, o: F.struct((s["c"] * (F.col("size") - o) / (o + 1)).alias("c"), (s["n"] + s["c"]).alias("n")))["n"]
    near = (F.col("lacks") <= 20) & (F.pow(F.lit(2.0), F.size("words")) * ways <= LETTER_KEYS)
    numbered = F.transform("found", lambda g, i: F.concat(g, F.size(F.filter(F.slice("found", 1, i), lambda x: x == g)).cast("string")))
    return d.select("name", "words", "size", near.alias("near"), numbered.alias("grams"), F.ceil(F.least(alike, inside) - across - 1e-9).alias("needed"))


def by_grams(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) for the prepared names of a and of b, of lengths that allow them
    to be alike as a whole, that meet on rare grams of the one or the other."""
    sides = {c: d.select("name", "size", "needed", F.explode("grams").alias("gram")) for c, d in (("a", a), ("b", b))}
    often = reduce(DataFrame.unionByName, sides.values()).groupBy("gram").agg(F.count("*").alias("n"))
    narrow = least / (200 - least)
    # lengths on a scale on which those alike are a step apart at most: a name stands at its own on one side, at the next ones too on the other
    at = F.log("size") / max(-math.log(narrow), 0.1)
    like = F.explode(F.sequence(F.floor(at - 1 - 1e-9), F.floor(at + 1 + 1e-9)))
    own = {"a": like.alias("long"), "b": F.floor(at).alias("long")}
    sizes = {c: F.col("size").alias(f"{c}_size") for c in sides}
    rare = {}
    for c, side in sides.items():
        ranked = side.join(often, "gram").groupBy("name", "size", "needed").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
        # the rest, without these, is one gram short of what is needed
        first = F.greatest(F.size("grams") - F.col("needed") + 1, F.lit(1)).cast("int")
        rare[c] = ranked.filter("needed >= 1").select("name", "size", F.explode(F.slice("grams", 1, first)).alias("x")).select(F.col("name").alias(c), "x.gram", sizes[c], own[c])
    all_ = {c: side.select(F.col("name").alias(c), "gram", sizes[c], own[c]) for c, side in sides.items()}

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        near = (F.col("b_size") >= F.ceil(F.col("a_size") * narrow - 1e-6)) & (F.col("b_size") <= F.floor(F.col("a_size") / narrow + 1e-6))
        return _dealt(x, "gram", "long").join(_dealt(y, "gram", "long"), ["gram", "long"]).filter(near).select("a", "b")

    return met(rare["a"], all_["b"]).unionByName(met(all_["a"], rare["b"])).distinct()


def _dealt(keyed: DataFrame, *keys: str) -> DataFrame:
    """Keys of names, dealt before they meet: Spark takes them for no more than the names that
    they come from, and would send millions of them to the driver for a broadcast."""
    return spread(keyed, *keys)


def by_words(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of which one is mostly inside the other: they meet on its rarest
    words, as few as leave less of it than must be common."""
    sides = {c: d.select("name", "size", F.explode("words").alias("word")) for c, d in (("a", a), ("b", b))}
    often = reduce(DataFrame.unionByName, sides.values()).groupBy("word").agg(F.count("*").alias("n"))
    rare = {}
    for c, side in sides.items():
        ranked = side.join(often, "word").groupBy("name", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("x"))
        rest = lambda i: F.length(F.array_join(F.slice(F.transform("x", lambda x: x["word"]), i + 1, F.size("x")), " "))
        own = F.filter("x", lambda x, i: rest(i) >= F.col("size") * (least / (200 - least)) - 1e-6)
        rare[c] = ranked.select(F.col("name").alias(c), F.explode(own).alias("x")).select(c, "x.word")
    all_ = {c: side.select(F.col("name").alias(c), "word") for c, side in sides.items()}
    met = lambda x, y: _dealt(x, "word").join(_dealt(y, "word"), "word").select("a", "b")
    return met(rare["a"], all_["b"]).unionByName(met(all_["a"], rare["b"]))


def without(text: str, n: int) -> set[str]:
    """What is left of a text without n of its letters, in all ways."""
    return {"".join(k) for k in combinations(text, len(text) - n)} if n <= len(text) else set()


def letter_keys(words: list[str], least: float, left: bool) -> set[str]:
    """The keys on which a name meets those alike as a whole: letters that the left name
    lacks, those that the right one lacks, the equal words and what is left of the others."""
    rate, size, out = 1 - least / 100, len(" ".join(words)), set()
    for k in range(1, len(words) + 1):
        for own in combinations(sorted(words), k):
            equal, text = " ".join(sorted(set(words) - set(own))), " ".join(own)
            for n in range(min(int(2 * rate / (1 + rate) * size + 1e-6), len(text)) + 1):
                # the other name has size - n + m letters, and lacks m
                most = max((m for m in range(size + 1) if n + m <= rate * (2 * size - n + m) + 1e-6), default=-1)
                if most >= 0:
                    kept = without(text, n)
                    for m in range(most + 1):
                        lacks = f"{n},{m}" if left else f"{m},{n}"
                        out.update(f"{lacks},{equal},{t}" for t in kept)
    return out


def by_letters(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) of the near names of a and of b that are alike as a whole."""
    def keyed(d: DataFrame, c: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 200):
                    part = batch.slice(start, 200)
                    names, keys = [], []
                    for name, words in zip(part.column("name").to_pylist(), part.column("words").to_pylist()):
                        own = letter_keys(words, least, c == "a")
                        keys.extend(own)
                        names.extend([name] * len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string())], [c, "key"])

        keys = spread(d.filter("near").select("name", "words"), "name").mapInArrow(run, f"{c} string, key string")
        return _dealt(keys.select(c, F.xxhash64("key").alias("key")), "key")

    return keyed(a, "a").join(keyed(b, "b"), "key").select("a", "b")


def similar_names(left: DataFrame, right: DataFrame, least: float, block: int = BLOCK_TERMS) -> DataFrame:
    """(a, b, score) of distinct cleaned names (columns a of left, b of right) with a
    score of `least` (above 0) or more. Null and empty names are like nothing."""
    a, b = (prepared(d.select(F.col(c).alias("name")), least) for d, c in ((left, "a"), (right, "b")))
    few, far = F.col("needed") < 1, ~F.col("near")
    texts = lambda d: d.select(F.col("name").alias("key"), F.col("name").alias("clean"), F.lit("").alias("low"))
    terms = lambda d: d.select(F.col("name").alias("canonical_name"), F.col("name").alias("term"), F.lit("name").alias("kind"), F.lit(0).alias("ordinal"), F.col("name").alias("clean"), F.array().cast("array<string>").alias("exclude"))
    pair = lambda d, x, y: d.select(F.col("key").alias(x), F.col("canonical_name").alias(y), "score").select("a", "b", "score")
    if least <= 200 / 3:  # every name is among the few
        return pair(similar_terms(texts(a), terms(b), None, least, 0.0, block), "a", "b")
    # each side is read many times
    spark = left.sparkSession
    sides = []
    for d in (a, b):
        path = work_path(spark, "names")
        d.write.parquet(path)
        sides.append(spark.read.parquet(path))
    a, b = sides
    has_few, has_far = ([not d.filter(c).isEmpty() for d in sides] for c in (few, ~few & far))
    short = []  # a short name may meet any: as a text against all of b, and as one against the longer ones of a
    if has_few[0]:
        short.append(pair(similar_terms(texts(a.filter(few)), terms(b), None, least, 0.0, block), "a", "b"))
    if has_few[1]:
        short.append(pair(similar_terms(texts(b.filter(few)), terms(a.filter(~few)), None, least, 0.0, block), "b", "a"))
    a, b = a.filter(~few), b.filter(~few)
    met = [by_words(a, b, least), by_letters(a, b, least)]
    if has_far[0]:
        met.append(by_grams(a.filter(far), b, least))
    if has_far[1]:
        met.append(by_grams(a.filter("near"), b.filter(far), least))
    ratio = F.pandas_udf(_token_set_ratio, "double")
    scored = spread(reduce(DataFrame.unionByName, met), "a").dropDuplicates(["a", "b"]).withColumn("score", F.round(ratio("a", "b"), 6))
    return reduce(DataFrame.unionByName, [scored.filter(F.col("score") >= least), *short])
