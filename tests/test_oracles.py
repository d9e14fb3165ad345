"""Every registered query runs; those with SQL equal DuckDB value by value."""

import pytest
from conftest import SF
from oracle import compare, duck

import __spark_entry__ as entry
from linkcast.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
