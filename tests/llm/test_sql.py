"""Registered queries of this part against their SQL, run by DuckDB."""

import duckdb
import pytest

from lodestar.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(str, (tuple(row) for row in result.fetchall())))
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == expected
