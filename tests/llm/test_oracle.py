"""The SQL of the training-data queries gives the rows of the queries, also behind a LIMIT."""

import duckdb
import pytest

from ledgerloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(f"{queries.oracle_sql()[name]} LIMIT 1000000")
    assert sorted(df.columns) == sorted(rel.columns)
    rows = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)
    assert rows == sorted(rel.fetchall(), key=str) and rows
