"""Every named query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from linkloom.catalog import QUERIES
from linkloom.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    ok, note = compare(spark, tables, name, QUERIES[name], ORACLE[name], SF)
    assert ok, note
