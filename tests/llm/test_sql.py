"""The contract queries that SQL can express, held against DuckDB."""

import glob
import os

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(df):
        return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False, name=None))

    assert rows(got) == rows(want)
