"""Every registered query with SQL, against DuckDB on the smallest tables; every other one runs and has columns."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import plain

SQL, QUERIES = entry.oracle_sql(), entry.queries()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small}/{f}')")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 60


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith(("p1_", "p4_", "p6_", "p7_", "p8_"))))
def test_as_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
