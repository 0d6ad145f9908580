"""Every registered query runs; those with SQL equal DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

FOLDER = "/root/testdata/sf0.001"
# reports that may be empty on the smallest tables
MAY_BE_EMPTY = {
    "s07_factor_regression", "s09_sub_period_regressions", "s10_weighting_by_frequency",
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(row[c]) for c in cols) for row in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got or name in MAY_BE_EMPTY
        return
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(row[i]) for i in at) for row in res.fetchall()), key=repr)


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns == ["bucket", "detail", "edges", "pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
