"""The driver's contract: every query of the library proper against its SQL on the smallest tables."""

import importlib
import os

import duckdb
import pytest

from lumentrace.plans import core_queries, host_queries, list_queries, pii_queries

QUERIES = pii_queries.QUERIES | core_queries.QUERIES | host_queries.QUERIES | list_queries.QUERIES
ORACLES = pii_queries.ORACLES | core_queries.ORACLES | host_queries.ORACLES | list_queries.ORACLES


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        cols = [c[0] for c in cur.description]
        want = sorted((tuple(norm(x) for _, x in sorted(zip(cols, r))) for r in cur.fetchall()), key=repr)
        assert sorted(cols) == sorted(df.columns) and got == want
    else:
        assert df.columns


def test_entry(spark, sf):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 6
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
