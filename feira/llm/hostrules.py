"""Quality rules by host: documents fail base rules on their own text, failures are
counted by domain, each domain's rate is shrunk with an empirical beta prior, and
the verdict on the domain is joined back to its documents.

A domain with few documents moves towards the corpus rate, so one bad page does
not condemn it; a large one keeps its own rate. Counts are partial aggregates and
the domain table is joined on its key; a domain with a third of all rows is one
row of that table, which Spark broadcasts if it is small and otherwise splits
(skewed join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows (of a power of two words) that occur twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == n:
        return 0
    x, k = np.fromiter(map(number.__getitem__, words), np.int64, n), 1
    while k < window:  # equal numbers: equal runs of 2k words
        x = x[:-k] * (int(x.max()) + 1) + x[k:]
        _, x, times = np.unique(x, return_inverse=True, return_counts=True)
        k *= 2
    often = np.flatnonzero(times[x] > 1)
    if not len(often):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            s = text.as_py() or ""
            b = s.encode()
            words = b.split()
            space = len(b) - len(b.translate(None, _SPACE))
            rows.append((len(words), len(s) - space, len(b) - len(b.translate(None, SYMBOLS)), dup_lines(b), repeat_words(words)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *(pa.array(c, pa.int64()) for c in cols)], names)


def measure(docs: DataFrame) -> DataFrame:
    """The base counts of every whole text, and base_failed."""
    d = with_columns(docs, {"doc_id": "long", "source": "string", "text": "string"})
    out = d.mapInArrow(_measure, "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_rates(measured: DataFrame, most: float = 0.5) -> DataFrame:
    """(source, base_failed) -> source, host_docs, host_rate (shrunk), host_failed.

    The beta prior has the corpus rate as mean; its strength comes from the spread of
    the domains' rates beyond what sampling alone gives (moments of the beta-binomial),
    kept between 1 and 1,000,000 documents.
    """
    h = measured.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    total = h.agg(F.count("*").alias("hosts"), F.sum("n").alias("all_n"), F.sum("f").alias("all_f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    h = h.crossJoin(F.broadcast(total))  # one row
    mean = F.col("all_f") / F.col("all_n")
    spread = h.agg(F.sum(F.col("n") * (F.col("f") / F.col("n") - mean) * (F.col("f") / F.col("n") - mean)).alias("ss"))
    h = h.crossJoin(F.broadcast(spread))  # one row
    free, noise = F.col("hosts") - 1, mean * (1 - mean)
    alike = F.try_divide(F.col("ss") - noise * free, noise * (F.col("all_n") - F.col("squares") / F.col("all_n") - free))
    strength = F.when(alike > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), 1 / alike - 1))).otherwise(F.lit(1e6))
    rate = (F.col("f") + mean * strength) / (F.col("n") + strength)
    return h.select("source", F.col("n").alias("host_docs"), rate.alias("host_rate"), (rate > most).alias("host_failed"))


def quality_rules(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, host_rate.

    kept is false if the document fails the base rules or its domain's shrunk
    failure rate is above `most`. A null text has no words and fails; documents of
    null source form one domain; rows with the same doc_id each get a row and count
    each. Texts of any length are measured whole. An empty table gives no rows.
    """
    m = materialize(measure(docs), "measured")
    hosts = materialize(host_rates(m, most), "hosts").alias("h")
    out = m.alias("m").join(hosts, F.expr("m.source <=> h.source"), "left")
    return out.select("m.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), "host_rate")
