"""Every registered query against its DuckDB oracle on the sf0.001 tables (value-level compare)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF

TABLES = ["customer", "part", "orders", "lineitem", "events", "documents"]
NAMES = list(E.oracle_sql())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "message", "message_upper", "message_length", "category"]
    assert df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())
