"""Which of many terms stand in which texts: one automaton over all terms of a block.

Texts and terms are cut into a grid (similar.py). In each cell the block's terms are
compiled into one automaton, which a text passes once, however many terms there are;
so the work grows with the texts' characters and the hits, and no term, short or
frequent, is a key that rows gather on.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .similar import grid

#: Terms that a task compiles at a time.
BLOCK_TERMS = 50_000


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(t, k)
    a.make_automaton()
    return a


def contained(texts: DataFrame, terms: DataFrame, block: int = BLOCK_TERMS) -> DataFrame:
    """(text, term), once each, of all terms that stand in a text. Null and empty
    ones give no row."""
    def run(own: pa.Table, far: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if own.num_rows and far.num_rows:
            found = far.column("term").to_pylist()
            a = _automaton(found)
            for text in own.column("text").to_pylist():
                hits = {k for _, k in a.iter(text)}
                out[0].extend([text] * len(hits))
                out[1].extend(found[k] for k in hits)
        return pa.table([pa.array(c, pa.string()) for c in out], ["text", "term"])

    a, b, cell = grid(_once(texts, "text"), _once(terms, "term"), "text", "term", block)
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(run, "text string, term string")


def least_contained(names: DataFrame, others: DataFrame, block: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """names (name), others (other, id): (name, id) twice, with the least id of the
    others that stand in the name, and of those in which the name stands. Each cell
    passes on one row a name, so a name inside everything costs no more than another."""
    least = F.min("id").alias("id")
    o = others.filter("other <> ''").groupBy("other").agg(least)
    n = _once(names.withColumnRenamed("name", "text"), "text").withColumnRenamed("text", "name")

    def inside(own: pa.Table, far: pa.Table) -> pa.Table:
        best: dict[str, object] = {}
        if own.num_rows and far.num_rows:
            a, ids = _automaton(far.column("other").to_pylist()), far.column("id").to_pylist()
            for name in own.column("name").to_pylist():
                best[name] = min((ids[k] for _, k in a.iter(name)), default=None)
        return _best(best, far)

    def around(own: pa.Table, far: pa.Table) -> pa.Table:
        best: dict[str, object] = {}
        if own.num_rows and far.num_rows:
            names_ = own.column("name").to_pylist()
            a = _automaton(names_)
            for other, x in zip(far.column("other").to_pylist(), far.column("id").to_pylist()):
                for k in {k for _, k in a.iter(other)}:
                    best[names_[k]] = min(best.get(names_[k], x), x)
        return _best(best, far)

    def _best(best: dict, far: pa.Table) -> pa.Table:
        hit = {k: v for k, v in best.items() if v is not None}
        return pa.table([pa.array(hit, pa.string()), pa.array(hit.values(), far.schema.field("id").type if far.num_rows else kind)], ["name", "id"])

    kind = pa.int64() if dict(o.dtypes)["id"] in ("int", "bigint") else pa.string()
    o = o.withColumn("id", F.col("id").cast("bigint" if kind == pa.int64() else "string"))
    a, b, cell = grid(n, o, "name", "other", block)
    schema = f"name string, id {dict(o.dtypes)['id']}"
    both = a.groupBy(*cell), b.groupBy(*cell)
    return tuple(both[0].cogroup(both[1]).applyInArrow(f, schema).groupBy("name").agg(least) for f in (inside, around))


def _once(d: DataFrame, column: str) -> DataFrame:
    return d.select(column).filter(F.col(column) != "").distinct()
