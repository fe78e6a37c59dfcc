"""Every registered query that SQL can express gives the same rows as its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 60
    assert {"item_id", "abc_class", "priority"} <= set(df.columns)
