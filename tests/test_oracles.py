"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    if name in SQL:
        count, difference = compare(df, con, SQL[name])
        assert difference == ""
    else:
        count = df.count()
    assert count > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert "is_anomaly" in entry.entry(spark).columns
