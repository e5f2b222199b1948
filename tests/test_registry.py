"""Every registered query: against DuckDB where SQL exists, for rows otherwise."""

import pytest

import __spark_entry__ as entry
from recordlab.registry.check import compare, duck_connection

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck_connection(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name, QUERIES[name], ORACLE.get(name)) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rec_id", "ratio", "age_years"]
    assert df.count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
