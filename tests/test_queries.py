"""Every query with reference SQL against DuckDB, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from framequery.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    a = catalog.QUERIES[name](spark, DATA).toPandas().astype(object)
    b = duck.execute(catalog.ORACLES[name]).df().astype(object)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].itertuples(index=False, name=None)))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
