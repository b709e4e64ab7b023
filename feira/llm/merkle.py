"""Merkle manifest of a dataset, and the proofs of all its rows by octopus multiproofs.

Every row is a leaf. The leaves of a tree (a value of `lang`) are numbered by a sort
over ranges, cut into aligned blocks of 2^height leaves, and hashed upwards block by
block, a few passes for any number of rows; only nodes from `height` up are stored.
The subroots are the leaves of one more tree, whose top is the root.

For the proofs a block (a leaf partition) works out the smallest set of node
coordinates that its own leaves can't give (`missing`), fetches these once by a join
with the stored nodes, hashes its shared interior nodes itself, and expands the
proof of each of its rows from both.

Nulls are `-` in a leaf; a null id sorts first and is never tampered with; rows that
repeat an id are ordered by their leaves, equal rows stand side by side, each with
its own place. An empty table gives no rows, a lone leaf is its own subroot, and a
row without a sibling at any level has the digest of an empty proof. Columns beside
the five, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_columns

#: Leaves of a block, as a power of two.
HEIGHT = 12
#: Key of the tree of subroots; those of languages are empty or begin with "=".
TOP = "^"
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields.values()]), 256))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree, doc_id, row, leaf and changed (the leaf after tampering, null where that
    changes nothing) of every row. Texts are read once and go no further."""
    d = with_columns(docs, FIELDS)
    whole = {c: F.col(c) for c in FIELDS}
    more = whole | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return d.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", F.monotonically_increasing_id().alias("row"),
        leaf_digest(whole).alias("leaf"), F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(more)).alias("changed"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, from 0 within their tree by `order` (nulls first), and size,
    the number of leaves of their tree. A sort over ranges; only a count for each
    range and tree is gathered, so a tree may have any share of the rows."""
    s = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    s = materialize(s.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    parts = s.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select(
        "tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size")), "merkle-parts")
    return (s.withColumn("part", F.shiftright("at", 33)).join(parts, ["tree", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"))


def lift(nodes: list[str]) -> list[str]:
    """The level above: of every two consecutive nodes, or a last lone one, the digest."""
    return [digest(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]


def _sorted(table: pa.Table, column: str) -> list[str]:
    order = np.argsort(table.column("pos").to_numpy())
    return [x.hex() for x in table.column(column).take(pa.array(order)).to_pylist()]


def _raise(nodes: DataFrame, level: int, height: int, least: int) -> DataFrame:
    """From the nodes of one level (tree, pos, size, digest), those of the levels
    above in their blocks that are stored: from `least` up, and every top."""

    def block(table: pa.Table) -> pa.Table:
        tree, size, at = table.column("tree")[0].as_py(), table.column("size")[0].as_py(), level
        first = min(table.column("pos").to_pylist())
        here, out = _sorted(table, "digest"), []
        if size == 1:
            out.append((at, first, here[0], True))
        while size > 1 and at < level + height:
            here, size, at, first = lift(here), (size + 1) // 2, at + 1, first >> 1
            if at >= least or size == 1:
                out += [(at, first + k, x, size == 1) for k, x in enumerate(here)]
        return pa.table({
            "tree": pa.array([tree] * len(out), pa.string()), "level": pa.array([x[0] for x in out], pa.int32()), "pos": pa.array([x[1] for x in out], pa.int64()),
            "digest": pa.array([bytes.fromhex(x[2]) for x in out], pa.binary()), "top": pa.array([x[3] for x in out], pa.bool_())})

    n = nodes.select("tree", "pos", "size", "digest", F.shiftright("pos", height).alias("block"))
    return n.groupBy("tree", "block").applyInArrow(block, "tree string, level int, pos long, digest binary, top boolean")


def build(rows: DataFrame, height: int, least: int) -> DataFrame:
    """tree, level, pos, digest and top of the nodes from level `least` up over
    numbered leaves (tree, pos, size, digest): one pass for every `height` levels."""
    found, level, here = [], 0, rows.select("tree", "pos", "size", "digest")
    while True:
        nodes = materialize(_raise(here, level, height, least), "merkle-nodes")
        found.append(nodes)
        level += height
        sizes = rows.filter("pos = 0").select("tree", F.ceil(F.col("size") / 2.0**level).alias("size")).filter("size > 1")
        here = nodes.filter(F.col("level") == level).join(sizes, "tree").select("tree", "pos", "size", "digest")
        if here.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@dataclass
class Manifest:
    """leaves: numbered, with `at`, the place of their tree among `trees`; nodes: the
    stored ones of all trees and of that of the subroots."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    trees: int
    height: int


def manifest(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> Manifest:
    rows = numbered(materialize(leaves(docs, tampered), "merkle-leaves"), ["doc_id", "leaf", "row"])
    nodes = build(rows.withColumnRenamed("leaf", "digest"), height, height)
    tops = nodes.filter("top").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest")
    subroots = materialize(numbered(tops, ["of"]), "merkle-subroots")
    above = build(subroots, height, 1)
    root = above.filter("top").select("digest").first()
    # a leaf partition holds no subroot but its own, so all nodes of their tree are stored
    low = subroots.select("tree", F.lit(0).alias("level"), "pos", "digest", F.lit(False).alias("top"))
    stored = nodes.unionByName(above.filter("level > 0")).unionByName(low)
    return Manifest(rows.join(subroots.select(F.col("of").alias("tree"), F.col("pos").alias("at")), "tree"),
                    stored, bytes(root["digest"]).hex() if root else None, subroots.count(), height)


def missing(lo: int, hi: int, size: int) -> Iterator[tuple[int, int]]:
    """The fewest nodes (level, pos) beside the leaves lo to hi - 1 from which the
    proofs of all of these follow: at each level at most one to either side."""
    level = 0
    while size > 1:
        if lo & 1:
            yield level, lo - 1
        if hi & 1 and hi < size:
            yield level, hi
        lo, hi, size, level = lo >> 1, (hi + 1) >> 1, (size + 1) >> 1, level + 1


def fold(leaf: str, path: list[tuple[bool, str | None]]) -> str:
    """The root that a leaf and its siblings, (the sibling is to the left, sibling),
    give; None is a run of one."""
    for left, sibling in path:
        leaf = digest(leaf) if sibling is None else digest(sibling, leaf) if left else digest(leaf, sibling)
    return leaf


def _path(pos: int, size: int, node, level: int = 0) -> list[tuple[bool, str | None]]:
    """The siblings of a leaf from `level` up; node(level, pos) gives them."""
    out = []
    pos, size = pos >> level, -(-size >> level)
    while size > 1:
        out.append((bool(pos & 1), node(level, pos ^ 1) if pos ^ 1 < size else None))
        pos, size, level = pos >> 1, (size + 1) >> 1, level + 1
    return out


def prove(m: Manifest, with_proof: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every
    leaf; with_proof adds its siblings from the leaf to the root."""
    height, trees, root = m.height, m.trees, m.root
    rows = m.leaves.withColumn("block", F.shiftright("pos", height))
    blocks = rows.groupBy("tree", "block").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.max("size").alias("size"), F.max("at").alias("at"))

    def wanted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = [(b.tree, b.block, tree, *x) for b in pdf.itertuples()
                   for tree, coordinates in ((b.tree, missing(b.lo, b.hi, b.size)), (TOP, missing(b.at, b.at + 1, trees))) for x in coordinates]
            yield pd.DataFrame(out, columns=["tree", "block", "of", "level", "pos"])

    wants = blocks.mapInPandas(wanted, "tree string, block long, of string, level int, pos long")
    # the same few nodes near the root are wanted by many blocks: Spark broadcasts the nodes or splits those keys
    fetched = wants.join(m.nodes.select(F.col("tree").alias("of"), "level", "pos", "digest"), ["of", "level", "pos"])

    def expand(own: pa.Table, far: pa.Table) -> pa.Table:
        own = own.take(pa.array(np.argsort(own.column("pos").to_numpy())))
        first, size, at = (own.column(c)[0].as_py() for c in ("pos", "size", "at"))
        sides: dict[str, dict[tuple[int, int], str]] = {TOP: {}, own.column("tree")[0].as_py(): {}}
        for of, level, pos, x in zip(*(far.column(c).to_pylist() for c in ("of", "level", "pos", "digest"))):
            sides[of][level, pos] = x.hex()
        mine, above = sides[own.column("tree")[0].as_py()], sides[TOP]
        levels, n = [[x.hex() for x in own.column("leaf").to_pylist()]], size
        while n > 1 and len(levels) <= height:
            levels.append(lift(levels[-1]))
            n = (n + 1) // 2
        local = len(levels) - 1
        for r, here in enumerate(levels):
            mine.update({(r, (first >> r) + k): x for k, x in enumerate(here)})
        node = lambda level, pos: mine[level, pos]
        shared = _path(first, size, node, local)
        top = _path(at, trees, lambda level, pos: above[level, pos])
        subroot = fold(levels[-1][0], shared)
        leaf, proof, proof_sha, folded = levels[0], [], [], []
        for k, changed in enumerate(own.column("changed").to_pylist()):
            path = [(bool(p & 1), mine.get((r, p ^ 1))) for r in range(local) for p in [(first + k) >> r]] + shared + top
            siblings = [x for _, x in path if x is not None]
            proof.append(siblings)
            proof_sha.append(digest(*siblings))
            folded.append(fold(leaf[k] if changed is None else changed.hex(), path))
        out = {"doc_id": own.column("doc_id"), "leaf": leaf, "subroot": [subroot] * len(leaf), "root": [root] * len(leaf), "proof_sha256": proof_sha,
               "folded_root": folded, "verified": [x == root for x in folded]}
        return pa.table(out | ({"proof": pa.array(proof, pa.list_(pa.string()))} if with_proof else {}))

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * with_proof
    return rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


def tampered(doc_id: Column) -> Column:
    """Every seventh id by its checksum; never a null one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest's proof of every row, folded from a leaf that was tampered with
    where `tampered` says so."""
    return prove(manifest(docs, tampered(F.col("doc_id")), height))
