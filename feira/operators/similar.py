"""The terms most similar to each text, exactly, without a row for every pair.

Texts and catalog are cut into a grid; in each cell a block of the catalog is an index
from words to terms. Terms
that share a word with a text are scored outright. Of all others the score has a
bound (characters in common, whatever their order), computed for the whole block at
once; they are scored from the highest bound down, until no bound can reach what is
already found. So the longest common subsequence is taken of a few pairs a text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import lcs_of

#: Terms of the catalog that a task holds at a time.
BLOCK_TERMS = 20_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as the session shuffles to, before costly work on
    each: the bytes of slim rows alone would make them one task."""
    conf = df.sparkSession.conf
    return df.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


def _round(x: float) -> float:
    return math.floor(x * 1e6 + 0.5) / 1e6


class Block:
    """Terms (canonical_name, term, kind, ordinal, clean, exclude) and their index."""

    def __init__(self, rows: list[tuple], penalty: float):
        self.rows, self.penalty = rows, penalty
        tokens = [r[4].split() for r in rows]
        self.words = [frozenset(t) for t in tokens]
        self.single = [len(t) == 1 for t in tokens]
        self.at: dict[str, list[int]] = {}
        for i, ws in enumerate(self.words):
            for w in ws:
                self.at.setdefault(w, []).append(i)
        joined = [" ".join(sorted(ws)) for ws in self.words]
        self.joined, self.lens = joined, np.array([len(j) for j in joined])
        self.column = {c: k for k, c in enumerate(sorted(set("".join(joined))))}
        self.chars = np.zeros((len(rows), len(self.column)), np.int16)
        for i, j in enumerate(joined):
            for c in j:
                self.chars[i, self.column[c]] += 1
        self.barred: dict[str, list[int]] = {}  # excluded text -> terms
        for i, r in enumerate(rows):
            for x in r[5] or ():
                self.barred.setdefault(x.lower(), []).append(i)

    def score(self, i: int, words: frozenset[str]) -> float:
        """Token-set similarity of a text's words with term i, less the penalty for
        words that stay unexplained."""
        own = self.words[i]
        if not words or not own:
            return 0.0
        both, a, b = words & own, words - own, own - words
        common, la, lb = len(" ".join(both)), len(" ".join(a)), len(" ".join(b))
        gap = 1 if both else 0
        if both and not (a and b):
            base = 100.0
        else:
            lcs = lcs_of(" ".join(sorted(a)), " ".join(sorted(b)))
            base = 100.0 * (1 - (la + lb - 2 * lcs) / (2 * (common + gap) + la + lb))
            if both:
                base = max(base, *(100.0 * 2 * common / (2 * common + gap + x) for x in (la, lb)))
        coverage = len(both) / (len(words) if self.single[i] and len(words) > 4 else len(own))
        return _round(base * (1 - self.penalty * (1 - coverage)))

    def best(self, text: str, low: str, n: int | None, least: float) -> list[tuple[float, int]]:
        """(score, term) of the n canonical names that score best, each by its best
        term (ties: the name, then the ordinal), or of all that reach `least`."""
        words = frozenset(text.split())
        barred = {i for x, own in self.barred.items() if x in low for i in own}
        found: dict[str, tuple[float, int, int]] = {}  # by name: -score, ordinal, term

        def take(i: int) -> None:
            name, _, _, ordinal = self.rows[i][:4]
            found[name] = min(found.get(name, (1.0, 0, 0)), (-self.score(i, words), ordinal, i))

        shared = {i for w in words for i in self.at.get(w, ())} - barred
        for i in shared:
            take(i)
        bag = np.zeros(len(self.column), np.int16)
        joined = " ".join(sorted(words))
        for c in joined:
            if c in self.column:
                bag[self.column[c]] += 1
        bound = 200.0 * (1 - self.penalty) * np.minimum(self.chars, bag).sum(1) / np.maximum(self.lens + len(joined), 1)
        bound[[*shared, *barred]] = -1
        for i in np.argsort(-bound, kind="stable").tolist():
            if n is None:
                floor = least
            else:
                floor = max(least, -sorted(found.values())[n - 1][0]) if len(found) >= n else least
            if bound[i] < 0 or bound[i] + 1e-6 < floor:
                break
            take(i)
        ranked = sorted((s, name, i) for name, (s, _, i) in found.items() if -s >= least)
        return [(-s, i) for s, _, i in ranked[:n]]


#: Texts that meet a block of terms at a time.
SLICE_TEXTS = 50_000


def grid(texts: DataFrame, terms: DataFrame, text_key: str, term_key: str, block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides cut by a hash of their keys, each slice of texts beside each block of
    terms: a cell holds at most about SLICE_TEXTS texts and `block` terms, whatever
    the keys, and nothing goes through the driver but the two counts."""
    conf, context = texts.sparkSession.conf, texts.sparkSession.sparkContext
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), context.defaultParallelism)
    blocks = max(1, -(-terms.count() // block))
    slices = max(-(-texts.count() // SLICE_TEXTS), -(-tasks // blocks))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["slice", "block"]
    # as many partitions as cells (or twice the tasks): slim rows would else be merged to one task
    n = min(slices * blocks, 2 * tasks) if slices * blocks > tasks else tasks
    a = texts.withColumns({"slice": part(text_key, slices), "block": every(blocks)}).repartition(n, *cell)
    b = terms.withColumns({"block": part(term_key, blocks), "slice": every(slices)}).repartition(n, *cell)
    return a, b, cell


def similar_terms(texts: DataFrame, terms: DataFrame, n: int | None, least: float = 0.0, penalty: float = 0.25, block: int = BLOCK_TERMS) -> DataFrame:
    """texts (key, clean, low) against terms (canonical_name, term, kind, ordinal,
    clean, exclude): key, canonical_name, term, kind, ordinal, score.

    For each key the n best canonical names with their best term, or all of score
    `least` and more (n None). Terms of whose `exclude` texts one stands in `low`
    play no part. Null keys give no row. All terms count, whatever their number.
    """
    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(6)]
        if own.num_rows and far.num_rows:
            index = Block(list(zip(*(far.column(c).to_pylist() for c in ("canonical_name", "term", "kind", "ordinal", "clean", "exclude")))), penalty)
            for key, clean, low in zip(*(own.column(c).to_pylist() for c in ("key", "clean", "low"))):
                for score, i in index.best(clean or "", low or "", n, least):
                    for col, x in zip(cols, (key, *index.rows[i][:4], score)):
                        col.append(x)
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], ["key", "canonical_name", "term", "kind", "ordinal", "score"])

    own = terms.select("canonical_name", "term", "kind", "ordinal", F.coalesce("clean", F.lit("")).alias("clean"), "exclude")
    a, b, cell = grid(texts.select("key", "clean", "low").filter("key is not null"), own, "key", "canonical_name", block)
    out = a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(run, "key string, canonical_name string, term string, kind string, ordinal int, score double")
    if n is None:
        return out
    w = Window.partitionBy("key").orderBy(F.desc("score"), "canonical_name")
    return out.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")
