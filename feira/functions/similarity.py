"""Similarity of strings and vectors as column expressions.

The longest common subsequence comes in two forms of equal results: a fold over
characters that stays in the JVM (for words inside arrays), and a bit-parallel one
on Arrow batches, which was faster by far on pairs of product texts.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    right, n = chars(b), F.length(b)
    start = F.array_repeat(F.lit(0), (n + 1).cast("int"))

    def row(prev: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.array(F.lit(0)),
            lambda r, j: F.concat(r, F.array(F.when(F.get(right, j - 1) == x, F.get(prev, j - 1) + 1)
                                             .otherwise(F.greatest(F.coalesce(F.get(prev, j), F.lit(0)), F.element_at(r, -1))))))

    return F.coalesce(F.get(F.aggregate(chars(a), start, row), n), F.lit(0))


def lcs_of(a: str, b: str) -> int:
    """Length of the longest common subsequence. One bit per character of a; a row of the table is one integer."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@cache
def _lcs_udf():
    @F.pandas_udf("int")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else lcs_of(x, y) for x, y in zip(a, b)], dtype="Int32")

    return lcs


def lcs_batched(a: Column, b: Column) -> Column:
    """lcs_length on Arrow batches."""
    return _lcs_udf()(a, b)


def fuzz_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (length of both); 100 for two empty strings."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / both)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of the word sets of two strings, 0 to 100.

    With I the common words and A, B the rest (sorted, joined by spaces): 0 if a
    string has no words; 100 if I is not empty and A or B is; else the largest of
    the similarity of 'I A' and 'I B', and (I not empty) of I with each of them.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))
    wa, wb = words(a), words(b)
    both = F.array_intersect(wa, wb)
    text = lambda w: F.array_join(F.array_sort(w), " ")
    i, da, db = text(both), text(F.array_except(wa, wb)), text(F.array_except(wb, wa))
    li, la, lb = F.length(i), F.length(da), F.length(db)
    gap = F.when(li > 0, 1).otherwise(0)
    total = 2 * (li + gap) + la + lb
    distance = la + lb - 2 * lcs_batched(da, db)
    joined = 100.0 * (1 - distance / total)
    with_i = lambda extra: F.when(li > 0, 100.0 * 2 * li / (2 * li + gap + extra)).otherwise(0.0)
    return (F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).when((li > 0) & ((la == 0) | (lb == 0)), 100.0)
            .otherwise(F.greatest(joined, with_i(la), with_i(lb))))


def coverage_penalty(score: Column, product: Column, term: Column, penalty: float = 0.25, least_tokens: int = 4) -> Column:
    """A score lowered by the share of words left unexplained: the term's words that
    the product lacks or, for a term of one word and a product of more than
    least_tokens words, the product's words beyond the term."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))
    wp, wt = words(product), words(term)
    common = F.size(F.array_intersect(wp, wt))
    single = (F.size(F.filter(F.split(F.trim(term), r"\s+"), lambda x: x != "")) == 1) & (F.size(wp) > least_tokens)
    coverage = F.when(single, common / F.size(wp)).when(F.size(wt) > 0, common / F.size(wt)).otherwise(0.0)
    return score * (1 - penalty * (1 - coverage))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
