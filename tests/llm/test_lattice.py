"""Lattice scores held against sums over all segmentations."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from feira.llm import lattice
from feira.llm.queries import pieces

SCHEMA = "doc_id long, text string, lang string, source string, word string, n int, row string, score string, held_out int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", "w", 1, "r", "x", 2) for r in rows], SCHEMA)


def segmentations(text, names):
    """All ways to cut a word (bytes) into pieces; a byte piece is an int."""
    if not text:
        yield ()
        return
    for rest in segmentations(text[1:], names):
        yield (text[0], *rest)
    for k in range(1, len(text) + 1):
        if text[:k] in names:
            for rest in segmentations(text[k:], names):
                yield (text[:k], *rest)


SMALL = {b" a": -1.0, b"a": -3.0, b"b": -4.0, b"ab": -2.0, b"ba": -5.0, b" ab": -6.0, "é".encode(): -7.0, b" ": -8.0, b"aba": -9.0}


def brute(rows, names, rounds, strength):
    worst = min(names.values())
    prior = {x: 1 / (3 - s) for x, s in names.items()} | {b: 1 / (3 - worst) for b in range(256)}
    prior = {x: v / sum(prior.values()) for x, v in prior.items()}
    low = {k: [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    c = collections.Counter(w for k in low if not held[k] for w in low[k])
    ends = sum(not x for x in held.values())
    p, total = prior, 0
    for _ in range(rounds):
        n = collections.Counter()
        for w, times in c.items():
            ways = [(s, math.prod(p[x] for x in s)) for s in segmentations(b" " + w, names)]
            for s, v in ways:
                for x in s:
                    n[x] += times * v / sum(v for _, v in ways)
        total = sum(n.values())
        p = {x: (n[x] + strength * len(p) * prior[x]) / (total + strength * len(p)) for x in p}
    end = (ends + 1) / (total + strength * len(p) + ends + 1)
    tokens, kinds = c.total() + ends, len(c) + (ends > 0)
    out = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((x + 1) / (tokens + kinds + 1)) for x in [*(c[w] for w in low[k]), ends])
        score = math.log10(end) + sum(math.log10(sum(math.prod(p[x] * (1 - end) for x in s) for s in segmentations(b" " + w, names))) for w in low[k])
        out.append((i, held[k], len(low[k]) + 1, sum(c[w] > 0 for w in low[k]) + (ends > 0), tokens, base, score))
    return out


def close(got, want):
    key = lambda x: (repr(x[:5]), round(x[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def result(df):
    return [tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]


ROWS = ([(i, " ".join("".join(random.Random(i * 100 + k).choices("abABé9", k=1 + (i + k) % 5)) for k in range(i % 9))) for i in range(60)]
        + [(None, "ab ab"), (3, "ab\x1cab \x0b q"), (3, "ab\x1cab \x0b q"), (70, None), (71, ""), (72, " \n")])


@pytest.mark.parametrize(("rounds", "hot"), [(0, 5), (2, 0), (2, 6), (1, 1000)])
def test_lattice(spark, rounds, hot):
    got = result(lattice.lm_score(docs(spark, ROWS).repartition(3), lattice.compile_pieces(SMALL), rounds=rounds, hot=hot, limit=20))
    close(got, brute(ROWS, SMALL, rounds, 1.0))


def test_lattice_edges(spark):
    v = lattice.compile_pieces(SMALL)
    assert result(lattice.lm_score(docs(spark, []), v)) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    close(result(lattice.lm_score(docs(spark, [(held, "ab b")]), v)), brute([(held, "ab b")], SMALL, 2, 1.0))
    close(result(lattice.lm_score(docs(spark, [(1, None)]), v)), brute([(1, None)], SMALL, 2, 1.0))
    # without a piece, bytes alone
    got = {r[0]: r[6] for r in result(lattice.lm_score(docs(spark, [(1, "ab"), (2, "b")]), lattice.compile_pieces({})))}
    assert got[1] < got[2] < 0
    # a very long word, and a text of a third of a million words
    rows = [(1, "ab" * 40_000), (2, "ab b " * 170_000), (4, "x")]
    got = {r[0]: r for r in result(lattice.lm_score(docs(spark, rows), v))}
    assert got[2][2] == 340_001 and all(math.isfinite(r[6]) for r in got.values())


def test_blocks_of_positions_agree():
    v = lattice.compile_pieces(SMALL)
    m = lattice.Lattice(v, np.log(v.prior), -3.0)
    word = np.frombuffer(b" " + b"abbaab" * 30, np.uint8)[None]
    few, many = (m.forward(word, k) for k in (1, 10**6))
    assert few == pytest.approx(many, nan_ok=True)
    assert m.expected(word, np.ones(1), 5) == pytest.approx(m.expected(word, np.ones(1)))
    # the pieces of a word cover it: expected lengths add up to its bytes
    size = np.array([len(x) for x in sorted(SMALL)] + [1] * 256)
    assert (m.expected(word, np.ones(1)) * size).sum() == pytest.approx(word.shape[1])


def test_vocabulary():
    v = lattice.load(pieces())
    assert v.prior.sum() == pytest.approx(1) and len(v.prior) > 30_000 and 8 < v.longest < 60
    m = lattice.Lattice(v, np.log(v.prior), -3.0)
    likely, unlikely = (m.forward(np.frombuffer(w, np.uint8)[None])[0, -1] for w in (b" the", b" xqz"))
    assert likely > unlikely
    total = np.zeros(1)
    for b in range(256):  # probabilities of one byte alone, over all bytes and pieces of a byte
        total += np.exp(m.forward(np.array([[b]], np.uint8))[:, -1])
    assert total[0] <= 1
