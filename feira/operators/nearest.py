"""The nearest names by edit distance, exactly, in rounds.

Two names at most d edits apart have a text in common that is left of either without
at most d letters. A round joins names on all such texts, so it finds all others within d
edits; a name is settled when its k-th store is more similar than one d + 1 edits away
can be. Names full of near ones are settled by the first rounds, whose pairs are few. What is left
has few near names, or long ones: it meets all names in blocks, where the table of
distances is filled for a block at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import work_path
from .names import without
from .similar import BLOCK_TERMS, grid, spread

#: Edits of the last round on common texts, and letters of a name that takes part in it.
ROUNDS, LONGEST = 2, 40


def _left(d: DataFrame, name: str, most: int) -> DataFrame:
    """Each row (name, first to be kept) and a hash of all that is left of the name
    without at most so many letters."""
    kept = d.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, at, keys = batch.slice(start, 200), [], []
                for i, x in enumerate(part.column(name).to_pylist()):
                    own = {t for n in range(most + 1) for t in without(x, n)}
                    keys.extend(own)
                    at.extend([i] * len(own))
                yield pa.RecordBatch.from_arrays([*part.select(kept).take(pa.array(at, pa.int32())).columns, pa.array(keys, pa.string())], [*kept, "key"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    return spread(spread(d, name).mapInArrow(run, schema + ", key string").withColumn("key", F.xxhash64("key")), "key")


def _best(pairs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """pairs (a, b, first, similarity) -> a, b_id, similarity, rank: the k best of each
    a. They are of its k best names, taken by their first id."""
    w, wn = (Window.partitionBy("a").orderBy(F.desc("similarity"), c) for c in ("b_id", "first"))
    few = pairs.withColumn("n", F.row_number().over(wn)).filter(F.col("n") <= k)
    return few.join(ids, "b").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("a", "b_id", "similarity", "rank")


def edit_distances(text: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distance of a text and each column of codes (code points, then zeros)."""
    rows, n = codes.shape
    row = [np.full(n, j, np.int32) for j in range(rows + 1)]
    for i, c in enumerate(text, 1):
        last, row[0] = row[0], np.full(n, i, np.int32)
        other = codes != ord(c)
        for j in range(1, rows + 1):
            best = np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + other[j - 1])
            last, row[j] = row[j], best
    return np.stack(row)[lengths, np.arange(n)]


def _all(asked: DataFrame, names: DataFrame, least: float, k: int, block: int) -> DataFrame:
    """(a, b, similarity) of the k nearest names in each block, and those as near as the k-th."""
    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], []]
        if own.num_rows and far.num_rows:
            b = sorted(far.column("b").to_pylist(), key=len)
            lengths = np.array([len(x) for x in b])
            codes = np.zeros((max(1, int(lengths[-1])), len(b)), np.int32)
            for i, x in enumerate(b):
                codes[:len(x), i] = [ord(c) for c in x]
            for a in own.column("a").to_pylist():
                # of other lengths none is similar enough
                lo, hi = np.searchsorted(lengths, len(a) * least - 1e-3), np.searchsorted(lengths, len(a) / least + 1e-3, "right")
                if lo < hi:
                    n = lengths[lo:hi]
                    found = np.floor((1 - edit_distances(a, codes[:n[-1], lo:hi], n) / np.maximum(np.maximum(n, len(a)), 1)) * 1e6 + 0.5) / 1e6
                    floor = max(least, np.partition(found, len(found) - k)[len(found) - k]) if len(found) > k else least
                    at = np.flatnonzero(found >= floor)
                    for col, x in zip(cols, ([a] * len(at), [b[lo + i] for i in at], found[at].tolist())):
                        col.extend(x)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], ["a", "b", "similarity"])

    x, y, cell = grid(asked.select("a"), names.select("b"), "a", "b", block)
    return x.groupBy(*cell).cogroup(y.groupBy(*cell)).applyInArrow(run, "a string, b string, similarity double")


def nearest_names(asked: DataFrame, ids: DataFrame, k: int, least: float, block: int = BLOCK_TERMS) -> DataFrame:
    """asked (a) and ids (b, b_id; a name's first k) -> a, b_id, similarity, rank: the k
    names of the highest similarity, 1 - edits / the longer length (ties by id), of
    `least` and more."""
    spark = asked.sparkSession
    left, names, done = asked.filter("a is not null").distinct(), ids.groupBy("b").agg(F.min("b_id").alias("first")), []
    for d in range(1, ROUNDS + 1):
        short = lambda c, n: F.length(c) <= n
        met = _left(left.filter(short("a", LONGEST)), "a", d).join(_left(names.filter(short("b", LONGEST + d)), "b", d), "key").select("a", "b", "first")
        met = spread(met, "a").dropDuplicates(["a", "b"])
        met = met.withColumn("similarity", F.round(1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"), F.lit(1)), 6)).filter(F.col("similarity") >= least)
        best, path = _best(met, ids, k), work_path(spark, f"nearest-{d}")
        # the most similar that a name more edits away can be
        more = F.round(1 - F.lit(d + 1) / (F.length("a") + d + 1), 6)
        best.write.parquet(path)
        best = spark.read.parquet(path)
        kth = best.filter(F.col("rank") == k).select("a", F.col("similarity").alias("kth"))
        settled = left.filter(short("a", LONGEST)).join(kth, "a", "left").filter((F.coalesce("kth", F.lit(-1.0)) > more) | (more < least)).select("a")
        done.append(best.join(settled, "a", "left_semi"))
        left = left.join(settled, "a", "left_anti")
    done.append(_best(_all(left, names, least, k, block).join(names, "b"), ids, k))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
