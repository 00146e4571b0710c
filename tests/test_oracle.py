"""Every core query with SQL against DuckDB, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from parley.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(cursor_or_df):
    names, data = cursor_or_df
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else x
    return sorted(names), sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = driver.queries()[name](spark, DATA)
    got = rows((df.columns, [tuple(r) for r in df.collect()]))
    cur = con.execute(catalog.oracle_sql()[name])
    assert got == rows(([c[0] for c in cur.description], cur.fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_and_queries_without_sql(spark):
    assert driver.entry(spark).count() == 1
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, DATA).count() > 0, name
