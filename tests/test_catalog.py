"""Every registered query against its SQL, on the smallest bundled tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def test_entry_returns_rows(spark):
    assert set(entry.entry(spark).columns) >= {"symbol", "horizon", "ic"}


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) == ""
    else:
        assert df.count() > 0
