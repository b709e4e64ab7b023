"""Toxicity by class-conditional Kneser-Ney models over words and their histories.

Two models, of toxic and of ordinary text, are compared by their length-normalised
log-likelihoods. In each, the probability of word w after word h has two factors:

- P(w), the class's discounted continuation counts (distinct words before w), with
  backoff to counts that the classes share (in how many of them w occurs at all);
- P(w | h) against what both classes together say of w after h: the class's own
  discounted continuation counts of the pair, with backoff to the counts of the
  pair over both classes, which back off to those of w.

The weight of a shared part is shared as well (the larger of the two classes'), so
an expression too rare to tell the classes apart has the same probability in both
and moves no score. Continuation counts (of distinct words before) stand in place of
occurrences at both orders, so copied passages add nothing.

A text's value is the largest length-normalised log-likelihood ratio of an
expression in it, that is of `span` words in a row: a text is toxic if some
expression in it is, however long it is. One monotone curve (isotonic regression),
fitted on labelled documents that the counts have not seen, turns it into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns
from .langid import _pieces, held_out

_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SPAN = 2


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts (runs of letters; any character beyond
    ASCII counts as one), hashes of the words before (0 at a start), and the number
    of words of each text."""
    split = [t.translate(_WORDS).split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    w = np.fromiter((h for s in split for h in map(xxhash.xxh64_intdigest, s)), np.uint64, int(n.sum()))
    h = np.concatenate([np.zeros(min(1, len(w)), np.uint64), w[:-1]])
    h[(np.cumsum(n) - n)[n > 0]] = 0
    return w, h, n


def _lower(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode() for x in column.to_pylist()]


def pair_code(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a word after another."""
    return h ^ ((w << np.uint64(1)) | (w >> np.uint64(63)))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (toxic, word two before, word before, word), as hashes."""
    for batch in batches:
        texts, y = _lower(batch.column("text")), batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b in _pieces(texts):
            w, h, n = _hashes(texts[a:b])
            g = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
            g[h == 0] = 0
            rows = np.unique(np.stack([np.repeat(y[a:b], n).astype(np.uint64), g, h, w], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3))], ["toxic", "g", "h", "w"])


@dataclass
class Model:
    """Log ratios (toxic over ordinary) of words, by hash, and what a word's ratio
    gains after another, by pair; those of ratio 0 are left out. at, curve: the
    monotone curve from a text's value to its score."""

    word: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    word_ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    pair: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pair_ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    curve: np.ndarray = field(default_factory=lambda: np.full(1, 0.499))
    span: int = SPAN

    def values(self, texts: list[bytes]) -> np.ndarray:
        """The largest mean log ratio of `span` words in a row in each lower-cased
        text (of all its words, if fewer; 0 of none)."""
        out = np.zeros(len(texts))
        for a, b in _pieces(texts):
            w, h, n = _hashes(texts[a:b])
            x = _find(self.word, self.word_ratio, w) + _find(self.pair, self.pair_ratio, pair_code(h, w))
            upto = np.concatenate([[0], np.cumsum(x)])
            start = np.cumsum(n) - n
            own = np.repeat(np.arange(b - a), n)
            k = np.minimum(n, self.span)[own]  # words of the expression that begins here
            at = np.arange(len(w))
            whole = at + k <= (start + n)[own]
            mean = np.where(whole, (upto[np.minimum(at + k, len(w))] - upto[:-1]) / k, -np.inf)
            out[a:b][n > 0] = np.maximum.reduceat(mean, start[n > 0]) if len(w) else 0
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.interp(self.values(texts), self.at, self.curve)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _sample(docs: DataFrame, labels: DataFrame, docs_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts, about docs_per_class of each class by a hash of the id, and
    how many there are of each class. Where a drawn id has many rows, a class has
    about twice docs_per_class of them by a hash of id and text; equal rows count once."""
    y = with_columns(labels, {"doc_id": "long", "toxic": "int"}).filter("doc_id is not null and toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    y = _part(y, {k: docs_per_class / n for k, n in sizes.items()}, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = with_columns(docs, {"doc_id": "long", "text": "string"}).filter("text is not null").join(F.broadcast(y), "doc_id")  # 2 docs_per_class ids
    rows = {r["toxic"]: r["count"] for r in d.groupBy("toxic").count().collect()}
    return _part(d, {k: 2 * docs_per_class / n for k, n in rows.items()}, "doc_id", "text").distinct(), sizes


def _part(rows: DataFrame, shares: dict[int, float], *by: str) -> DataFrame:
    """The given share of the rows of each class, by a hash of columns."""
    share = F.lit(0.0)
    for k, part in shares.items():
        share = F.when(F.col("toxic") == k, min(1.0, part)).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(*by, F.lit("toxic")), F.lit(1_000_000)) < share * 1_000_000)


def word_ratios(pairs: DataFrame, discount: float) -> DataFrame:
    """(h, w, t, o: continuation counts) -> w, both (continuations of both classes
    together), ratio."""
    w = pairs.groupBy("w").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in "to"], F.count("*").alias("both"))
    w = w.withColumn("classes", (F.col("t") > 0).cast("int") + (F.col("o") > 0).cast("int"))
    total = w.agg(F.sum("classes").alias("n_classes"), F.sum("both").alias("n_both"),
                  *[f for c in "to" for f in (F.sum(c).alias(f"n_{c}"), F.sum(F.least(F.col(c), F.lit(discount))).alias(f"cut_{c}"))])
    w = w.crossJoin(F.broadcast(total))  # one row
    weight = F.greatest(*[F.coalesce(F.try_divide(f"cut_{c}", f"n_{c}"), F.lit(1.0)) for c in "to"])
    p = {c: (1 - weight) * F.coalesce(F.try_divide(F.col(c) - F.least(F.col(c), F.lit(discount)), F.col(f"n_{c}") - F.col(f"cut_{c}")), F.lit(0.0))
         + weight * F.col("classes") / F.col("n_classes") for c in "to"}
    return w.select("w", (F.col("both") / F.col("n_both")).alias("both"), F.log(p["t"] / p["o"]).alias("ratio"))


def pair_ratios(pairs: DataFrame, word: DataFrame, discount: float, strength: float) -> DataFrame:
    """What the word before adds: h, w, ratio. Only words before that both classes
    have say anything."""
    cut = {c: F.least(F.col(c), F.lit(discount)) for c in "to"}
    all_, cut_all = F.col("t") + F.col("o"), F.least(F.col("t") + F.col("o"), F.lit(discount))
    above = pairs.groupBy("h").agg(F.sum(cut_all).alias("cut_all"), *[f for c in "to" for f in (F.sum(c).alias(f"n_{c}"), F.sum(cut[c]).alias(f"cut_{c}"))])
    x = pairs.join(above.filter("n_t > 0 and n_o > 0"), "h").join(word.select("w", "both"), "w")
    shared = (all_ - cut_all + F.col("cut_all") * F.col("both")) / (F.col("n_t") + F.col("n_o"))
    weight = F.greatest(*[(F.col(f"cut_{c}") + strength) / (F.col(f"n_{c}") + strength) for c in "to"])
    q = {c: (1 - weight) * F.coalesce(F.try_divide(F.col(c) - cut[c], F.col(f"n_{c}") - F.col(f"cut_{c}")), F.lit(0.0)) + weight * shared for c in "to"}
    return x.select("h", "w", F.log(q["t"] / q["o"]).alias("ratio"))


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = 4000, word_discount: float = 3.0, pair_discount: float = 3.0,
          strength: float = 300.0, span: int = SPAN) -> Model:
    """Fit on a bounded sample of labelled rows (docs_per_class of each class); three
    quarters of it are counted, all words and pairs of them, and the curve is fitted
    on the rest. Words and pairs of up to their discount of continuations have no probability
    of their own; strength is how many counts the shared pair counts are worth. Without
    labelled rows of both classes every score is below 0.5."""
    sample, sizes = _sample(docs, labels, docs_per_class)
    if len(sizes) < 2:
        return Model(span=span)
    sample = materialize(sample.withColumn("check", F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) == 0), "toxic-sample")
    grams = sample.filter("not check").select("text", "toxic").mapInArrow(_trigrams, "toxic int, g long, h long, w long").distinct()
    pairs = grams.groupBy("h", "w").agg(*[F.sum((F.col("toxic") == k).cast("long")).alias(c) for k, c in ((1, "t"), (0, "o"))])
    pairs = materialize(pairs, "toxic-pairs")
    word = materialize(word_ratios(pairs, word_discount), "toxic-words")
    m = Model(span=span)
    found = word.filter("ratio <> 0").select("w", "ratio").toPandas()
    m.word, m.word_ratio = _sorted(found["w"].to_numpy(np.int64).view(np.uint64), found["ratio"].to_numpy(float))
    found = pair_ratios(pairs, word, pair_discount, strength).filter("ratio <> 0").select("h", "w", F.col("ratio").cast("float")).toPandas()
    m.pair, m.pair_ratio = _sorted(pair_code(*(found[c].to_numpy(np.int64).view(np.uint64) for c in "hw")), found["ratio"].to_numpy(np.float32))
    return _calibrate(m, sample.filter("check"), sizes)


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best non-decreasing curve: its corners, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # first x, last x, weight, weighted y
    for k in np.argsort(x, kind="stable"):
        blocks.append([x[k], x[k], weight[k], weight[k] * y[k]])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]):
            _, last, w, s = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + w, blocks[-1][3] + s]
    return np.array([v for a, b, _, _ in blocks for v in (a, b)]), np.array([v for _, _, w, s in blocks for v in (s / w, s / w)])


def _calibrate(m: Model, rows: DataFrame, sizes: dict[int, int]) -> Model:
    """Fit the curve on the sample's other documents, weighted to the classes' shares."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(shared.value.values(_lower(batch.column("text"))))], ["toxic", "x"])

    pdf = rows.select("text", "toxic").mapInArrow(value, "toxic int, x double").toPandas()
    y, x = pdf["toxic"].to_numpy(float), pdf["x"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        m.at, m.curve = np.array([-1.0, 0.0, 1.0]), np.array([0.4, 0.499, 0.6])
        return m
    share = sizes[1] / (sizes[0] + sizes[1])
    m.at, m.curve = isotonic(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text.

    Null and wordless texts have the value 0, so the score of a text that says
    nothing; repeated rows score alike and null ids pass through. Extra columns,
    whatever their names, are ignored; an empty table gives no rows. A text of any
    length is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(_lower(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Train on labels whose crc32(doc_id) mod 5 is not 0; score all documents."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)), **params)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
