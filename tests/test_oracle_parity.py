"""Every query that has SQL gives the SQL's rows, over the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connection, rows_of

NAMES = sorted(n for n in entry.queries() if n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con(data_dir):
    return connection(data_dir)


@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, con, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    got = df.collect()
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, got) == rows_of(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
