"""Divergence of the sources of a language: how far the word shares of every two lie
apart, and the terms that a source overuses.

Terms are counted in one pass over the texts, each task folding its own counts. The
kept terms make a term-major index: a row for each term with the posting of every
source. The distances come from Gustavson's row accumulation over that index. A
source (a row of the sparse matrix of sources and terms) begins with a dense
accumulator of one cell per peer, filled as if every peer lacked all its terms (the
share of a count of zero, which smoothing makes positive); then each of its terms is
scattered through the index and corrects the peers that have it. The terms are cut
into slabs of a bounded number of postings, and only dense rows leave a slab, never
a pair of postings. All arithmetic is in whole numbers.

Null text, language and source count as ''. A document without terms still makes its
(language, source) group occur. A language without kept terms has distances of 0 and
no overused terms; one with one source has no pairs. Equal values rank by item.
Repeated rows count each; ids are not looked at. Columns beside the three, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, with_columns

#: A share counts in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Bytes of a UTF-8 text: letters of ASCII in lower case, others beyond ASCII as they are, the rest a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in found.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "df"])
            found.clear()

        for batch in batches:
            lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for k, text in enumerate(batch.column("text").cast(pa.binary())):
                n, df = found.setdefault((lang[k], source[k]), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in slices(text.as_py().translate(_TERMS)):
                    words = piece.split()
                    n.update(words)
                    own.update(words)
                df.update(own)
                held += len(n) - before
                if held >= limit:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def term_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) of all terms. A task
    holds up to `limit` counts, then passes them on."""
    d = docs.mapInArrow(_counts(limit), "lang string, source string, term string, n long, df long")
    # dealt by language and term, which the sums here and over all sources of a term share
    return d.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, terms: str, smooth: int) -> Column:
    """The smoothed share of a term, in whole units, exact for counts of any size."""
    exact = f"1 + (cast({SCALE} as decimal(18,0)) * ({count} + {smooth})) div ({total} + {smooth} * {terms})"
    return F.expr(f"case when {terms} > 0 then {exact} end")


def groups(docs: DataFrame, cells: DataFrame, smooth: int) -> DataFrame:
    """Every (lang, source) that occurs, with the number of its place among the
    sources of the language, how many those are, total (its occurrences of kept
    terms), terms (kept in the language), lang_total, postings, and zero (the share
    of a count of 0)."""
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    lang = cells.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"), F.count("*").alias("postings"))
    g = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(lang, "lang", "left").fillna(0)
    w = Window.partitionBy("lang")
    g = g.withColumns({"place": F.row_number().over(w.orderBy("source")) - 1, "sources": F.count("*").over(w), "zero": share("0", "total", "terms", smooth)})
    return materialize(g, "divergence-groups")


def _accumulate(chunk: int):
    def run(key: tuple, index: pa.Table, peers: pa.Table) -> pa.Table:
        order = np.argsort(peers.column("place").to_numpy())
        zero = peers.column("zero").fill_null(0).to_numpy()[order]
        own = peers.column("own").to_numpy(zero_copy_only=False)[order]
        base = peers.column("terms").to_numpy()[0] if key[1].as_py() == 0 else 0  # once for all slabs
        posted = index.column("place").combine_chunks()
        posted = posted if isinstance(posted, pa.ListArray) else pa.array([], pa.list_(pa.int32()))
        shared = index.column("share").combine_chunks()
        start = np.concatenate([[0], np.cumsum(np.diff(posted.offsets.to_numpy()))]).astype(np.int64)
        peer, p = posted.flatten().to_numpy(), (shared.flatten().to_numpy() if len(posted) else np.zeros(0, np.int64))
        term = np.repeat(np.arange(len(posted)), np.diff(start))
        by_row = np.argsort(peer, kind="stable")
        at = np.searchsorted(peer[by_row], np.arange(len(zero) + 1))
        rows = []
        for g in np.flatnonzero(own):
            mine = by_row[at[g]:at[g + 1]]
            t, pg = term[mine], p[mine]
            # every peer as if it had none of these terms
            s = np.sort(pg)
            upto = np.concatenate([[0], np.cumsum(s)])
            k = np.searchsorted(s, zero)
            row = zero * k - upto[k] + (upto[-1] - upto[k]) - zero * (len(s) - k) - len(s) * np.abs(zero[g] - zero)
            row[g + 1:] += base * np.abs(zero[g] - zero[g + 1:])
            # peers that have them; each two sources meet once, at the earlier one
            size = start[t + 1] - start[t]
            size_upto = np.cumsum(size)
            cuts = np.unique([0, *(np.searchsorted(size_upto, np.arange(chunk, size.sum(), chunk)) + 1), len(t)])
            for a, b in zip(cuts[:-1], cuts[1:]):
                n = size[a:b]
                where = np.repeat(start[t[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                h, ph, x = peer[where], p[where], np.repeat(pg[a:b], n)
                later = h > g
                h, ph, x = h[later], ph[later], x[later]
                fix = np.abs(x - ph) - np.abs(x - zero[h]) - np.abs(ph - zero[g]) + np.abs(zero[g] - zero[h])
                np.add.at(row, h, fix)
            rows.append(row)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "place": pa.array(np.flatnonzero(own), pa.int32()), "row": pa.array(list(rows), pa.list_(pa.int64()))})

    return run


def distances(cells: DataFrame, g: DataFrame, smooth: int, slab: int = 50_000, rows: int = 1000, chunk: int = 2_000_000) -> DataFrame:
    """lang, a, b (places, a < b), value: the summed differences of the shares of all
    kept terms. A slab has about `slab` postings (or as many as there are pairs of
    sources, if more); `rows` sources at a time accumulate over it."""
    postings = F.greatest(F.lit(slab).cast("long"), F.col("sources") * F.col("sources"))
    cut = g.withColumns({"slabs": F.greatest(F.lit(1), F.ceil(F.col("postings") / postings)), "cuts": F.ceil(F.col("sources") / rows)})
    x = cells.join(cut, ["lang", "source"]).withColumn("share", share("n", "total", "terms", smooth))
    x = x.groupBy("lang", "term").agg(F.collect_list("place").alias("place"), F.collect_list("share").alias("share"), F.max("slabs").alias("slabs"), F.max("cuts").alias("cuts"))
    index = x.select("lang", F.pmod(F.xxhash64("term"), "slabs").alias("slab"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "place", "share")
    peers = (cut.withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
             .select("lang", "slab", "cut", "place", "zero", "terms", (F.floor(F.col("place") / rows) == F.col("cut")).alias("own")))
    keys = ("lang", "slab", "cut")
    acc = index.groupBy(*keys).cogroup(peers.groupBy(*keys)).applyInArrow(_accumulate(chunk), "lang string, place int, row array<long>")
    pairs = acc.select("lang", "place", F.posexplode("row").alias("peer", "value")).filter("place <> peer")
    return pairs.groupBy("lang", F.least("place", "peer").alias("a"), F.greatest("place", "peer").alias("b")).agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top_terms: int = 50, **sizes: int) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of the language by
    distance (`pair`), and the terms with a larger share than in the whole language
    (`term`, up to the rank top_terms)."""
    d = with_columns(docs, dict.fromkeys(("lang", "source", "text"), "string")).fillna("")
    term = Window.partitionBy("lang", "term")
    cells = (term_counts(d).withColumns({"kept": F.sum("df").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
             .filter(F.col("kept") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"))
    cells = materialize(cells, "divergence-cells")
    g = groups(d, cells, smooth)
    name = g.select("lang", "place", "source")
    pair = materialize(distances(cells, g, smooth, **sizes), "divergence-pairs")
    pair = pair.join(name.toDF("lang", "a", "source"), ["lang", "a"]).join(name.toDF("lang", "b", "item"), ["lang", "b"])
    pair = pair.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    over = (cells.join(g, ["lang", "source"])
            .withColumn("value", share("n", "total", "terms", smooth) - share("lang_n", "lang_total", "terms", smooth))
            .filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pair.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).filter(F.col("rank") <= top_terms))
