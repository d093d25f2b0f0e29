"""The training-data queries that SQL can express against their twins; every query gives rows and runs natively where it must."""

import duckdb
import pytest

from vettrail.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf, name):
    other = duckdb.connect()
    for t in ("documents", "embeddings"):
        other.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    twin = other.sql(queries.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    assert sorted(tuple(r[k] for k in columns) for r in df.collect()) == sorted(twin.select(*[f'"{k}"' for k in columns]).fetchall())


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == [*range(1, 11)]


@pytest.mark.parametrize("name", ["op2_sharding", "op3_licence_scan"])
def test_native(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
