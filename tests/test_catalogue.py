"""Every query with SQL agrees with DuckDB on the smallest tables; the others have a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenqa.plans import catalogue
from lumenqa.plans.base import TABLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if x is None or x != x:
        return "none"
    if isinstance(x, float):
        return f"{x:.5f}"
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "n", "f1", "em"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
