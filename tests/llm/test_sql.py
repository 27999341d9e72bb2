"""Corpus queries that have SQL, against that SQL run by DuckDB on the same tables."""

import duckdb
import pytest

from conftest import SF
from runlens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SF).select(columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall()))
