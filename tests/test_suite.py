"""Every registered query against the independent engine."""

import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import suite

TABLES = suite.TABLES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if isinstance(v, decimal.Decimal) else v


def rows(names, order, data):
    at = [names.index(c) for c in order]
    return sorted((tuple(cell(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", list(suite.queries()))
def test_same_rows(spark, sf_dir, oracle, name):
    got = suite.queries()[name](spark, sf_dir)
    want = oracle.sql(suite.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert rows(got.columns, order, got.collect()) == rows(want.columns, order, want.fetchall())


ORDERED = [n for n, text in suite.SQL.items() if "ORDER BY" in text.rsplit(")", 1)[-1] and "SELECT l_returnflag, l_linestatus, l_orderkey" not in text]


@pytest.mark.parametrize("name", ORDERED)
def test_same_order(spark, sf_dir, oracle, name):
    got, want = suite.queries()[name](spark, sf_dir), oracle.sql(suite.SQL[name])
    order = got.columns
    assert [tuple(map(cell, r)) for r in got.collect()] == [tuple(cell(r[want.columns.index(c)]) for c in order) for r in want.fetchall()]


@pytest.mark.parametrize("name, tables", [("casts", ["lineitem"]), ("join_cross", ["region", "nation"])])
def test_whole_tables(spark, sf_dir, oracle, name, tables):
    want = math.prod(oracle.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in tables)
    assert suite.queries()[name](spark, sf_dir).count() == want
