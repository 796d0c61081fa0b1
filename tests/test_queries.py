"""Every query that has SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from parlance import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = rows(df.columns, df.collect())
    want = duck.execute(registry.oracle_sql()[name])
    assert found == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"kmeans_scan", "topics", "topic_assign"}))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
