"""The Merkle manifest held against a tree built in plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from feira.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, leaf int, size int, row int, digest string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z") for r in rows], SCHEMA)


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: levels([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for pos, (_, _, own, r) in enumerate(sorted(trees[x], key=lambda t: t[:3])):
            path = [(p >> k, lv[(p >> k) ^ 1] if (p >> k) ^ 1 < len(lv) else None) for tree, p in ((built[x], pos), (top, at)) for k, lv in enumerate(tree[:-1])]
            change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(*r[:4], r[4] + 1) if change else own
            for p, s in path:
                h = sha(h) if s is None else sha(s, h) if p & 1 else sha(h, s)
            out.append((r[0], own, built[x][-1][0], top[-1][0], sha(*(s for _, s in path if s is not None)), h, h == top[-1][0]))
    return out


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


ROWS = ([(i, f"text {i}", ("en", "de", None, "Ωz", "", "zz")[min(5, i % 11)] if i % 3 else "en", f"s{i % 4}" if i % 5 else None, 7 * i if i % 6 else None) for i in range(700)]
        + [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (None, "x", "en", "s", 2), (None, None, "en", None, None), (8, "", "en", "", 0), (-4, "é日" * 50_000, "one", "s", 2**63 - 1)])


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_merkle(spark, height):
    assert result(merkle.merkle_manifest(docs(spark, ROWS).repartition(5), height)) == sorted(brute(ROWS), key=repr)


def test_merkle_small(spark):
    assert result(merkle.merkle_manifest(docs(spark, []), 2)) == []
    for rows in (ROWS[:1], ROWS[:2], ROWS[:9], [(1, "a", "en", "s", 1)] * 40 + [(2, "b", "en", "s", 1)] * 20):
        assert result(merkle.merkle_manifest(docs(spark, rows), 2)) == sorted(brute(rows), key=repr)
    # columns that are missing count as null
    only = spark.createDataFrame([(3,)], "doc_id long")
    assert result(merkle.merkle_manifest(only)) == sorted(brute([(3, None, None, None, None)]), key=repr)


def test_missing_is_minimal():
    r = random.Random(5)
    for _ in range(300):
        size = r.randrange(1, 70)
        lo = r.randrange(size)
        hi = r.randrange(lo + 1, size + 1)
        # what all proofs need, less what the leaves give
        sizes = [size]
        while sizes[-1] > 1:
            sizes.append((sizes[-1] + 1) // 2)
        have, need = {(0, p) for p in range(lo, hi)}, set()
        for k, n in enumerate(sizes[:-1]):
            here = {p for at, p in have if at == k}
            need |= {(k, p ^ 1) for p in here if p ^ 1 < n and p ^ 1 not in here}
            have |= {(k + 1, p >> 1) for p in here}
        assert sorted(merkle.missing(lo, hi, size)) == sorted(need)


def test_proofs_fold(spark):
    rows = ROWS[:60]
    m = merkle.manifest(docs(spark, rows), F.lit(False), height=2)
    for x in merkle.prove(m, with_proof=True).collect():
        assert x["verified"] and x["root"] == m.root and x["proof_sha256"] == sha(*x["proof"])
