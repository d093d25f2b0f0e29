"""Every registered query of the core against its SQL twin on the smallest tables, and the rest for rows."""

import math

import duckdb
import pytest

from vettrail.plans import oracle, queries

TABLES = ("events", "documents", "pages", "conversations")
TWINS = oracle.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def other(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, sf, other, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    twin = other.sql(TWINS[name])
    assert sorted(twin.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in twin.select(*[f'"{k}"' for k in columns]).fetchall()), key=repr)
    assert got


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(TWINS)))
def test_rows(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0
