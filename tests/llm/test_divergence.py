"""Divergence of sources held against plain Python over all terms."""

from __future__ import annotations

import collections
import itertools
import random
import re

import pytest

from feira.llm import divergence
from feira.llm.common import slices

SCHEMA = "doc_id long, text string, lang string, source string, term string, place int, n string, value int, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, "y", 2, "z") for k, r in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top=50):
    n, df, groups, lang_n = collections.Counter(), collections.Counter(), set(), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        for w in words:
            n[lang, source, w] += 1
            lang_n[lang, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), k in df.items() if x == lang and k >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(count):
            total = sum(map(count, kept))
            return {w: 1 + 10**9 * (count(w) + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: shares(lambda w: n[lang, s, w]) for s in sources}
        q = shares(lambda w: lang_n[lang, w])
        for s in sources:
            pair = sorted((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s)
            term = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if n[lang, s, w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Été", "ÉTÉ", "日本", "A", "a", " b", "x y"]
    rows = [(" ".join(r.choice("- 9_.\x1c")[:1] + r.choice(words[: 20 + 15 * (k % 8)]) for _ in range(r.randrange(40))), ("en", "de", None, "")[min(3, k % 6)], f"s{k % 9}" if k % 4 else None) for k in range(n)]
    return rows + [(None, "en", "empty"), ("", "en", "empty2"), ("only here", "xx", "one"), (None, "yy", None), ("a b", "zz", "p"), ("c", "zz", "q"), ("wa " * 300_000, "en", "s1")]


@pytest.mark.parametrize("sizes", [{}, {"slab": 1, "rows": 2, "chunk": 7}])
def test_divergence(spark, sizes):
    rows = corpus(600)
    assert result(divergence.source_divergence(docs(spark, rows).repartition(5), min_docs=10, **sizes)) == brute(rows, 10)


def test_divergence_edges(spark):
    assert result(divergence.source_divergence(docs(spark, []))) == []
    rows = [(None, None, None)] * 3 + [("a", None, "s")]
    assert result(divergence.source_divergence(docs(spark, rows))) == brute(rows, 30)
    rows = [("A b", "en", f"s{k % 2}") for k in range(80)] + [("b", "en", "s0")] * 3  # ties
    assert result(divergence.source_divergence(docs(spark, rows))) == brute(rows, 30)
    assert result(divergence.source_divergence(docs(spark, corpus(200)), min_docs=3, top_terms=4)) == brute(corpus(200), 3, 4)


def test_shares_are_exact(spark):
    # counts far beyond a long's range once scaled
    n, total, terms = 7 * 10**15 + 3, 9 * 10**16 + 7, 10**9 + 1
    d = spark.createDataFrame([(n, total, terms), (0, 0, 0)], "n long, total long, terms long")
    got = [r[0] for r in d.select(divergence.share("n", "total", "terms", 5)).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * terms), None]


def test_flushed_counts(spark):
    rows = corpus(60)
    few, many = (sorted(map(tuple, divergence.term_counts(docs(spark, rows).select("lang", "source", "text").fillna(""), limit=k).collect())) for k in (1, 10**6))
    assert few == many


def test_slices():
    for text in (b"", b"a b", b"abc" * 10, b"ab cd ef gh"):
        for size in (1, 2, 5, 100):
            got = list(slices(text, size))
            assert b"".join(got) == text and list(itertools.chain(*(x.split() for x in got))) == text.split()
