"""Registered queries against their SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from lodestar.plans import registry, relational, shapes, spatial, storage, timeseries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    return con


def _text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([_text(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted([_text(row[i]) for i in at] for row in result.fetchall())
    assert sorted([_text(row[c]) for c in columns] for row in df.collect()) == expected
