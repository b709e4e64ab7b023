"""Language-model scores by a lattice of subwords: the probability of a text under a
unigram model of pieces, summed over all its segmentations.

A word is the space before it and its bytes; its segmentations are the paths of a
lattice whose arcs are the pieces of an existing vocabulary that match there, and
the vocabulary's byte pieces, so every text has a probability. The marginal of a
word comes from a forward recursion in log space, all words of one length together.
A text is its words, one after another, and one end.

The vocabulary and its scores exist. The scores of a file of merges are ranks: they
give the prior, in which a piece is as likely as its rank by Zipf's law. The training
words then weight it: `rounds` rounds of expected piece counts over the lattices of
all distinct training words (forward and backward), added to the prior. Counts of
words, of pieces and of ends cover all training documents.

Each distinct word of the corpus is scored once, in a table of words. The most
frequent (a number bounded by `hot`) are broadcast; the others of each document are
joined with the table by a shuffle on the word, in which none can be hot.

A null text counts as empty: it is its end alone. Null ids train (they are in no
fold) and pass through; repeated rows are each counted and scored. Words of any
length are scored whole, a block of positions at a time. An empty table gives no
rows; if nothing trains, the prior alone scores. Columns beside the two, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, with_columns
from .langid import held_out

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOG10 = np.log(10.0)


@dataclass
class Pieces:
    """An existing vocabulary as a trie of bytes: (state, byte) keys in order with the
    next state, and the piece that ends at a state (or -1). The byte pieces are the
    last 256."""

    keys: np.ndarray
    next: np.ndarray
    piece: np.ndarray
    prior: np.ndarray
    longest: int

    @property
    def bytes_from(self) -> int:
        return len(self.prior) - 256


def load(path: str) -> Pieces:
    """Pieces of a vocabulary file, with `▁` as the space before a word. Control
    pieces and those that no word can hold (a space within, or more than one before)
    are left out. The prior of a score s <= 0 is in proportion to 1 / (3 - s), bytes
    come after the last rank."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    found = {}
    for k in range(m.get_piece_size()):
        if m.is_control(k) or m.is_unknown(k) or m.is_unused(k) or m.is_byte(k):
            continue
        text = m.id_to_piece(k).replace("▁", " ")
        if " " not in text[1:]:
            found[text.encode()] = min(0.0, m.get_score(k))
    return compile_pieces(found)


def compile_pieces(scores: dict[bytes, float]) -> Pieces:
    """A trie of pieces with scores of 0 or less, the higher the likelier."""
    names = sorted(scores)
    edge: dict[tuple[int, int], int] = {}
    piece = [-1]
    for k, name in enumerate(names):
        state = 0
        for b in name:
            after = edge.setdefault((state, b), len(piece))
            if after == len(piece):
                piece.append(-1)
            state = after
        piece[state] = k
    keys = np.array([s << 8 | b for s, b in edge], np.int64)
    order = np.argsort(keys)
    worst = min([0.0, *scores.values()])
    weight = 1 / (3 - np.array([scores[x] for x in names] + [worst] * 256))
    return Pieces(keys[order], np.array(list(edge.values()), np.int32)[order], np.array(piece, np.int32), weight / weight.sum(), max(map(len, names), default=1))


@dataclass
class Lattice:
    """Log probabilities of the pieces and of the end."""

    pieces: Pieces
    log: np.ndarray
    end: float

    def arcs(self, text: np.ndarray) -> np.ndarray:
        """Piece by (word, first byte, length - 1), -1 where none: text has the bytes
        of words of one length."""
        n, width = text.shape
        v = self.pieces
        out = np.full((n, width, min(v.longest, width)), -1, np.int32)
        row, col = (x.ravel() for x in np.indices((n, width), np.int32))
        state, reached = np.zeros(len(row), np.int64), 0
        for k in range(out.shape[2]):
            on = col + k < width
            row, col, state = row[on], col[on], state[on]
            key = state << 8 | text[row, col + k]
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1) if len(v.keys) else np.zeros(len(key), int)
            on = v.keys[at] == key if len(v.keys) else np.zeros(len(key), bool)
            row, col, state = row[on], col[on], v.next[at[on]].astype(np.int64)
            if not len(row):
                break
            ends = v.piece[state]
            out[row, col, k] = ends
            if (ends >= 0).any():
                reached = k + 1
        return out[:, :, :max(reached, 1)]

    def _blocks(self, text: np.ndarray, cells: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, arcs, their log weights) over the positions of words, a block at
        a time; a byte piece joins the piece of one byte at a position."""
        n, width = text.shape
        step = max(1, min(width, cells // n))
        log = np.append(self.log, -np.inf)
        for a in range(0, width, step):
            b = min(width, a + step)
            arc = self.arcs(text[:, a:min(width, b + self.pieces.longest - 1)])[:, :b - a]
            w = log[arc]
            w[:, :, 0] = np.logaddexp(w[:, :, 0], self.log[self.pieces.bytes_from + text[:, a:b].astype(np.int64)])
            yield a, b, arc, w

    def forward(self, text: np.ndarray, cells: int = 65_536) -> np.ndarray:
        """Log probability of all ways to reach each position of words of one length."""
        n, width = text.shape
        alpha = np.full((n, width + self.pieces.longest + 1), -np.inf)
        alpha[:, 0] = 0
        for a, b, _, w in self._blocks(text, cells):
            for k in range(a, b):
                reach = alpha[:, k + 1:k + 1 + w.shape[2]]
                np.logaddexp(reach, alpha[:, k:k + 1] + w[:, k - a], out=reach)
        return alpha[:, :width + 1]

    def expected(self, text: np.ndarray, weight: np.ndarray, cells: int = 65_536) -> np.ndarray:
        """Expected counts of the pieces in words of one length, each weighted."""
        n, width = text.shape
        alpha = self.forward(text, cells)
        beta = np.full((n, width + self.pieces.longest + 1), -np.inf)
        beta[:, width] = 0
        out = np.zeros(len(self.log))
        first = self.pieces.bytes_from
        step = max(1, min(width, cells // n))
        for a in range((width - 1) // step * step, -1, -step):
            b = min(width, a + step)
            arc = self.arcs(text[:, a:min(width, b + self.pieces.longest - 1)])[:, :b - a]
            w = np.append(self.log, -np.inf)[arc]
            byte = first + text[:, a:b].astype(np.int64)
            for k in range(b - 1, a - 1, -1):
                after = beta[:, k + 1:k + 1 + w.shape[2]]
                on, by_byte = w[:, k - a] + after, self.log[byte[:, k - a]] + after[:, 0]
                all_ = np.concatenate([on, by_byte[:, None]], 1)
                top = all_.max(1)
                beta[:, k] = top + np.log(np.exp(all_ - top[:, None]).sum(1))
                part = np.exp(alpha[:, k:k + 1] + all_ - alpha[:, width:]) * weight[:, None]
                here = arc[:, k - a]
                out += np.bincount(here[here >= 0], part[:, :-1][here >= 0], len(out)) + np.bincount(byte[:, k - a], part[:, -1], len(out))
        return out


def by_length(words: list[bytes], cells: int = 65_536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as a matrix) of words with their space before, of one length
    each; about `cells` bytes at a time, or one word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for n in np.unique(size):
        at = order[np.searchsorted(size[order], n):np.searchsorted(size[order], n, "right")]
        step = max(1, cells // (n + 1))
        for k in range(0, len(at), step):
            some = at[k:k + step]
            yield some, np.frombuffer(b"".join(b" " + words[j] for j in some), np.uint8).reshape(len(some), n + 1)


def _word_counts(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = Counter(), Counter()  # of all documents, of those that train

        def flush() -> pa.RecordBatch:
            words = list(n)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([c[w] for w in words], pa.int64()), pa.array(list(n.values()), pa.int64())], ["word", "c", "n"])
            n.clear()
            c.clear()
            return out

        for batch in batches:
            for text, held in zip(batch.column("text").cast(pa.binary()), batch.column("held_out").to_pylist()):
                for piece in slices((text.as_py() or b"").translate(_LOWER)):
                    words = piece.split()
                    n.update(words)
                    if not held:
                        c.update(words)
                    if len(n) >= limit:
                        yield flush()
        yield flush()

    return run


def _spread(df: DataFrame) -> DataFrame:
    """Slim rows with costly work, dealt to as many tasks as the session shuffles to."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def fit(words: DataFrame, ends: int, pieces: Pieces, rounds: int = 2, strength: float = 1.0) -> Lattice:
    """Piece probabilities: the expected counts in all training words, and the prior
    worth `strength` counts a piece. A round sends one number a piece to the driver."""
    p = pieces.prior
    spark = words.sparkSession
    trained = _spread(words.filter("c > 0").select("word", "c"))
    total = 0.0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Lattice(pieces, np.log(p), 0.0))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(shared.value.log))
            for batch in batches:
                c = batch.column("c").to_numpy()
                for at, text in by_length(batch.column("word").to_pylist()):
                    out += shared.value.expected(text, c[at].astype(float))
            k = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(out[k])], ["piece", "n"])

        found = trained.mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros(len(p))
        n[found["piece"].to_numpy()] = found["n"].to_numpy()
        total = n.sum()
        p = (n + strength * len(p) * pieces.prior) / (total + strength * len(p))
    # the end is one more piece: a share of all pieces and ends
    end = (ends + 1) / (total + strength * len(p) + ends + 1)
    return Lattice(pieces, np.log(p) + np.log1p(-end), float(np.log(end)))


def score_words(words: DataFrame, model: Lattice) -> DataFrame:
    """word, c, n and log10_p, the marginal of each distinct word."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, text in by_length(batch.column("word").to_pylist()):
                out[at] = shared.value.forward(text)[:, -1] / LOG10
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "c", "n")), pa.array(out)], ["word", "c", "n", "log10_p"])

    return _spread(words).mapInArrow(run, "word binary, c long, n long, log10_p double")


def most_frequent(words: DataFrame, hot: int, max_bytes: int = 64) -> DataFrame:
    """At most `hot` of the words, the most frequent, of up to max_bytes."""
    words = words.filter(F.octet_length("word") <= max_bytes)
    step = F.floor(F.log2("n") * 8)  # some hundreds of steps, whatever the counts
    least, held = None, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > hot:
            break
        least = r["step"]
    return words.filter(step >= least) if least is not None else words.limit(0)


@dataclass
class Known:
    """The frequent words with their counts and marginals."""

    words: list[bytes]
    c: np.ndarray
    log10_p: np.ndarray

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def _look_up(known: Known, batches: Iterator[pa.RecordBatch], end: tuple[int, int, float]) -> Iterator[pa.RecordBatch]:
    """A row for each document with what its frequent words add up to, and one for
    each of its other words."""
    find, c = known.index.get, known.c
    add = np.stack([np.ones(len(c)), c > 0, np.log10(c + 1.0), known.log10_p], 1)
    own = np.array([1, end[1] > 0, np.log10(end[1] + 1.0), end[2]])
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]

    def doc_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((batch.num_rows, 4)) + own
        row, word, times = [], [], []
        rows = batch.column("row").to_pylist()
        for k, text in enumerate(batch.column("text").cast(pa.binary())):
            rare: Counter = Counter()
            for piece in slices((text.as_py() or b"").translate(_LOWER)):
                w = piece.split()
                at = np.fromiter(map(find, w, repeat(-1)), np.int64, len(w))
                sums[k] += add[at[at >= 0]].sum(0)
                rare.update(w[j] for j in np.flatnonzero(at < 0))
            sums[k, 0] += rare.total()
            row += [rows[k]] * len(rare)
            word += rare.keys()
            times += rare.values()
            if len(row) > 200_000:
                yield other(row, word, times)
                row, word, times = [], [], []
        yield other(row, word, times)
        yield pa.RecordBatch.from_arrays([
            batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64)),
            pa.array(sums[:, 2]), pa.array(sums[:, 3]), pa.nulls(batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.int64())], names)

    def other(row: list, word: list, times: list) -> pa.RecordBatch:
        n = len(row)
        return pa.RecordBatch.from_arrays([
            pa.array(row, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(word, pa.binary()), pa.array(times, pa.int64())], names)

    for batch in batches:
        yield from doc_rows(batch)


def lm_score(docs: DataFrame, vocabulary: str | Pieces, folds: int = 7, fold: int = 2, rounds: int = 2, strength: float = 1.0,
             hot: int = 200_000, limit: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    whole text, learning from the documents whose checksum of the id, modulo `folds`,
    is not `fold`. Scores are log10 probabilities."""
    spark = docs.sparkSession
    pieces = vocabulary if isinstance(vocabulary, Pieces) else load(vocabulary)
    d = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    counted = d.select("text", "held_out").mapInArrow(_word_counts(limit), "word binary, c long, n long")
    words = materialize(counted.repartition("word").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    ends = d.filter("not held_out").count()
    got = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = got["n"] + ends, got["v"] + (ends > 0)
    model = fit(words, ends, pieces, rounds, strength)
    scored = materialize(score_words(words, model), "lm-scored")
    known = most_frequent(scored, hot).toPandas()  # at most `hot` short rows
    shared = spark.sparkContext.broadcast(Known([bytes(w) for w in known["word"]], known["c"].to_numpy(np.int64), known["log10_p"].to_numpy(float)))
    end = (1, ends, model.end / LOG10)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"
    rows = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda batches: _look_up(shared.value, batches, end), schema)
    rows = materialize(rows, "lm-rows")
    rest = rows.filter("word is not null").select("row", "word", "times").join(scored, "word").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * F.log10(F.col("c") + 1)).alias("base"), (F.col("times") * F.col("log10_p")).alias("score"))
    whole = rows.filter("word is null").drop("word", "times").unionByName(rest)
    whole = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"), "score")
