"""Every registered query of the engine against its DuckDB form."""

import datetime as dt
import decimal

import duckdb
import pytest

from minnow import queries
from tests.conftest import SMALL

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in NAMES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


def test_all_have_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    df, want = queries.queries()[name](spark, SMALL), duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    rows = sorted((tuple(map(plain, r)) for r in df.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str) and rows
