"""Every query with SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tableweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want


def test_every_query_runs(spark):
    for name, f in catalog.queries().items():
        if name not in SQL:
            assert f(spark, SF).columns
