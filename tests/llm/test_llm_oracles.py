"""The queries of the package that SQL can express, over whole tables, and that all are registered."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from ringledger.llm import queries

SF = "/root/testdata/sf0.01"


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {*queries.queries(), "pipeline"} <= set(found)
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
    assert found["pipeline"] is corpus_pipeline.run
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as from '{SF}/{table}.parquet'")
    answer = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    want = answer.fetchall()
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want)
