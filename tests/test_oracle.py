"""Every query with SQL against DuckDB; the others must give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import SF, TABLES

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield connection
    connection.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert rows
    if name not in ORACLES:
        return
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())
    assert len(rows) == len(expected)
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    assert not wrong, wrong[:3]


def test_entry(spark):
    out = contract.entry(spark)
    assert {"key", "date", "rate", "SMA_5", "log_return", "volatility_20"} <= set(out.columns)
    assert out.count() == 5
