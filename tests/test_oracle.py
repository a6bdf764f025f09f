"""Every registered query against its oracle SQL on the smallest supplied tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
    else:
        assert compare(df.columns, rows, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
