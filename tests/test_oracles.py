"""Retail queries against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from feira.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()[:19]
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted("|".join(norm(r[c]) for c in cols) for r in df.collect()) == sorted("|".join(norm(r[c]) for c in cols) for r in want)
