"""Every query with SQL against DuckDB on the smallest tables; the flagship query."""

import duckdb
import pytest

from scanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in cols))) for r in df.collect())
    rel = con.sql(catalog.ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    assert got == sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries(spark):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE_SQL):
        assert catalog.QUERIES[name](spark, DATA).count() > 0, name
