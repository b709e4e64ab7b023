"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes: a byte is predicted
from the longest context (up to three bytes) that the language's training text
has, and an escape probability leads to the next shorter context when the byte
was not seen there (method C with exclusion, down to a uniform floor). Statistics
are frozen after training, so every (context, byte) has one exact code length: if
the byte was seen there, a length of its own, else that of the escape and the one
in the shorter context. The trees are kept whole, as sorted tables of the strings
that were seen, in groups of a few languages whose strings share a table; a text
costs one look-up of each byte and its context in each group, in NumPy, over whole
Arrow batches.

The text is reduced to letters first: ASCII letters in lower case, all other
ASCII characters as one separator, bytes from 128 up as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

UND = "und"
SLICE = 1 << 18

_LOWER = np.zeros(256, np.uint8)
_LOWER[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[128:] = np.arange(128, 256)


def _symbols(texts: list[bytes], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after another (0: separator, runs folded), and
    where each text starts; every text starts with a separator."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    s = lut[np.frombuffer(b"\0" + b"\0".join(texts), np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    keep[starts] = True
    at = np.cumsum(keep)[starts] - 1
    return s[keep], at


def _contexts(s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The three symbols before each one as a number; 0s before a text's start."""
    out, n = np.zeros(len(s), np.int32), len(s)
    for back, weight in ((1, 1), (2, size), (3, size * size)):
        c = np.zeros(n, np.int32)
        c[back:] = s[:-back] if back < n else 0
        for k in range(back):
            at = starts + k
            c[at[at < n]] = 0
        out += c * np.int32(weight)
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _pieces(texts: list[bytes], most: int = 4 * SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a few MB; a longer text is a range of its own."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        if total + len(t) > most and i > a:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = _texts(batch.column("text")), batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for a, b in _pieces(own):
                s, starts = _symbols(own[a:b], _LOWER)
                code = _contexts(s, starts, 256).astype(np.int64) * 256 + s
                live = np.ones(len(s), bool)
                live[starts] = False
                codes, n = np.unique(code[live], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n)], ["lang", "code", "n"])


@dataclass
class Group:
    """Trees of a few languages. seen[k]: strings of a context of k bytes and the
    byte after it, sorted, that any of them has, bits[k] their code lengths by
    language; contexts[3]: contexts of three bytes, escapes[k] the code lengths of
    leaving a context. Orders 0 and 1 and the escapes of order 2 are whole tables."""

    langs: list[str]
    seen: dict[int, np.ndarray]
    bits: dict[int, np.ndarray]
    contexts: np.ndarray
    escapes: dict[int, np.ndarray]

    def lengths(self, code: np.ndarray, size: int) -> np.ndarray:
        """Code lengths by language of each byte, given with its context of three."""
        at, hit = _at(self.seen[3], code)
        out = self.bits[3][at]
        if not hit.all():
            out[~hit] = self._escaped(code[~hit], size)
        return out

    def _escaped(self, code: np.ndarray, size: int) -> np.ndarray:
        short = code % size**3
        at, hit = _at(self.seen[2], short)
        out = np.where(hit[:, None], self.bits[2][at], self.escapes[2][short // size] + self.bits[1][short % size**2])
        at, hit = _at(self.contexts, code // size)
        return out + np.where(hit[:, None], self.escapes[3][at], np.float32(0))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class PPM:
    """langs; lut: byte -> symbol, of which there are size; groups of languages."""

    langs: list[str]
    lut: np.ndarray
    groups: list[Group]
    size: int

    def code_lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text under each language, and symbols of each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in _pieces(texts):
            s, starts = _symbols(texts[a:b], self.lut)
            ends = np.append(starts[1:], len(s))
            n[a:b] = ends - starts - 1
            code = (_contexts(s, starts, self.size).astype(np.int64) * self.size + s).astype(np.uint32)
            live = np.ones(len(s), bool)
            live[starts] = False
            for lo in range(0, len(s), SLICE):
                hi = min(lo + SLICE, len(s))
                first = np.searchsorted(ends, lo, "right")
                last = np.searchsorted(starts, hi, "left")
                at = np.maximum(starts[first:last], lo) - lo
                k = 0
                for g in self.groups:
                    bits = g.lengths(code[lo:hi], self.size) * live[lo:hi, None]
                    total[a + first:a + last, k:k + len(g.langs)] += np.add.reduceat(bits, at, axis=0, dtype=np.float64)
                    k += len(g.langs)
        return total, n


def _alphabet(used: np.ndarray) -> tuple[np.ndarray, int]:
    """byte -> symbol (0: separator, the last: bytes that no training text has), and
    the number of symbols."""
    used = np.unique(used[used != 0])
    other = len(used) + 1
    lut = np.where(_LOWER == 0, 0, other).astype(np.uint8)
    lut[used] = np.arange(1, len(used) + 1)
    upper = np.arange(ord("A"), ord("Z") + 1)
    lut[upper] = lut[upper + 32]
    return lut, other + 1


def _tree(code: np.ndarray, n: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """One language's counts of strings of four symbols -> for each order 0 to 3:
    strings seen, their probabilities, contexts seen, probabilities of an escape
    (over what is left to the shorter context)."""
    out = []
    for k in range(4):
        seen, which = np.unique(code % size ** (k + 1), return_inverse=True)
        count = np.bincount(which, n)
        contexts, own = np.unique(seen // size, return_inverse=True)
        # what the shorter context says of the symbols seen here
        lower = np.full(len(seen), 1 / size) if k == 0 else out[-1][1][np.searchsorted(out[-1][0], seen % size**k)]
        left = 1 - np.bincount(own, lower)
        total, kinds = np.bincount(own, count), np.bincount(own)
        open_ = left > 1e-12
        every = total + np.where(open_, kinds, 0)
        escape = np.where(open_, kinds / every / np.maximum(left, 1e-12), 0.0)
        out.append((seen, count / every[own], contexts, escape))
    return out


def compile_group(counts: dict[str, tuple[np.ndarray, np.ndarray]], lut: np.ndarray, size: int) -> Group:
    """Counts of strings of four bytes by language -> the group's tables."""
    langs, trees = sorted(counts), {}
    for lang, (c, n) in counts.items():
        sym = [lut[(c >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
        trees[lang] = _tree(((sym[0] * size + sym[1]) * size + sym[2]) * size + sym[3], n, size)
    seen = {k: np.arange(size ** (k + 1)) if k < 2 else np.unique(np.concatenate([t[k][0] for t in trees.values()])) for k in range(4)}
    contexts = {k: np.arange(size**k) if k < 3 else np.unique(np.concatenate([t[k][2] for t in trees.values()])) for k in range(4)}
    bits = {k: np.empty((len(seen[k]), len(langs)), np.float32) for k in range(4)}
    escapes = {k: np.zeros((len(contexts[k]), len(langs)), np.float32) for k in range(4)}
    for j, lang in enumerate(langs):
        p = np.full(1, 1 / size)  # of an empty context's symbols, whatever they are
        for k, (own, mine, above, escape) in enumerate(trees[lang]):
            leave = np.ones(len(contexts[k]))
            leave[np.searchsorted(contexts[k], above)] = escape
            lower = p[np.searchsorted(seen[k - 1], seen[k] % size**k)] if k else np.full(size, 1 / size)
            p = leave[np.searchsorted(contexts[k], seen[k] // size)] * lower
            p[np.searchsorted(seen[k], own)] = mine
            bits[k][:, j] = -np.log2(np.maximum(p, 1e-300))
            escapes[k][:, j] = -np.log2(np.maximum(leave, 1e-300))
    return Group(langs, {k: seen[k].astype(np.uint32) for k in (2, 3)}, bits, contexts[3].astype(np.uint32), escapes)


def train(labelled: DataFrame, docs_per_lang: int = 1000, group: int = 8) -> PPM | None:
    """Fit on a bounded sample: about docs_per_lang documents of each language, by a
    hash of id and text (so null or shared ids neither drop nor bring a whole language),
    equal rows once. Every language is learned, and every string of its sample; the
    driver holds the counts of `group` languages at a time, and the model grows with
    the number of languages. None if nothing is labelled."""
    d = with_columns(labelled, {"doc_id": "long", "text": "string", "lang": "string"}).filter("lang is not null and text is not null")
    sizes = d.groupBy("lang").count()
    few = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000)) < 1_000_000.0 * docs_per_lang / F.col("count")
    d = d.join(F.broadcast(sizes), "lang").filter(few).select("lang", "doc_id", "text").distinct()  # sizes: a row for each language
    n = d.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    n = materialize(n, "strings")
    langs = sorted(r["lang"] for r in n.select("lang").distinct().collect())
    if not langs:
        return None
    used = n.select(F.explode(F.array(*[F.shiftright("code", k).bitwiseAND(255) for k in (0, 8, 16, 24)])).alias("b")).distinct().collect()
    lut, size = _alphabet(np.array([r["b"] for r in used]))
    groups = []
    for k in range(0, len(langs), group):
        pdf = n.filter(F.col("lang").isin(langs[k:k + group])).toPandas()
        groups.append(compile_group({x: (g["code"].to_numpy(), g["n"].to_numpy()) for x, g in pdf.groupby("lang")}, lut, size))
    return PPM([x for g in groups for x in g.langs], lut, groups, size)


def predict(docs: DataFrame, model: PPM | None, carry: dict[str, str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every whole text.

    The score is the posterior of the best language under its exact code lengths
    and even priors. A null text, one of no letter, or any text under no model is
    `und` with score 0. Texts of any length are scored whole, in slices. Repeated
    rows are scored alike; equal code lengths go to the language first by name.
    Columns to carry (name: type) follow in each row; other columns, whatever their
    names, are ignored. An empty table gives no rows, and null ids pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = _texts(batch.column("text"))
            bits, n = m.code_lengths(texts) if m else (np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64))
            letters = np.array([_has_letter(t) for t in texts], bool) & bool(m)
            best = bits.argmin(1) if len(texts) else np.zeros(0, int)
            low = bits.min(1) if len(texts) else np.zeros(0)
            post = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1) if len(texts) else low
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([m.langs[b] if ok else UND for b, ok in zip(best, letters)], pa.string()),
                pa.array(np.where(letters, post, 0.0)), pa.array(np.where(letters, low / np.maximum(n, 1), 0.0)),
                *(batch.column(c) for c in carry),
            ], ["doc_id", "lang_pred", "score", "bits_per_byte", *carry])

    d = with_columns(docs, {"doc_id": "long", "text": "string"} | carry)
    return d.mapInArrow(score, ", ".join(["doc_id long, lang_pred string, score double, bits_per_byte double", *(f"{c} {t}" for c, t in carry.items())]))


def _has_letter(text: bytes) -> bool:
    if text.isascii():
        return bool(text.strip(_NOT_LETTERS))
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, **params) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 4 is not 2 and predict all rows."""
    model = train(docs.filter(~held_out(F.col("doc_id"), 4, 2)), **params)
    return predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
