"""Every registered query against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

from ringledger.plans import catalog, oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        if name.endswith(".parquet"):
            view = name.removesuffix(".parquet")
            connection.execute(f"CREATE VIEW {view} AS FROM '{SF_DIR}/{name}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())


def test_the_entry_holds_every_query():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(oracles.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    answer = duck.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    expected = _rows(columns, answer.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = _rows(df.columns, [tuple(row) for row in df.collect()])
    assert got, "no rows"
    assert got == expected
