import duckdb
import pytest

from tessera.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == sorted(rows, key=repr)
