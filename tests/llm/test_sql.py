"""Operators whose meaning SQL can express: query and SQL over the small tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from feira.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def value(x):
        return float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = comparable(want.fetchall(), names)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert comparable([tuple(r) for r in got.collect()], got.columns) == rows
