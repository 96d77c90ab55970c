"""Every query against its SQL on the smallest tables."""

import datetime as dt
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in pathlib.Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return f"{value:.6f}"
    return value.isoformat() if isinstance(value, dt.datetime) else str(value)


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, sql, name):
    result = contract.queries()[name](spark, SF)
    rows = result.collect()
    assert rows
    if name not in contract.oracle_sql():
        return
    cursor = sql.execute(contract.oracle_sql()[name])
    expected = comparable([c[0] for c in cursor.description], cursor.fetchall())
    assert comparable(result.columns, rows) == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
