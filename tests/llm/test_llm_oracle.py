"""Queries with SQL equal their DuckDB result on the smallest tables."""

import duckdb
import pytest
from cases import SF_SMALL

from cartlens.llm.oracle import ORACLE_SQL
from cartlens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert got.dtypes[columns].tolist() == want.dtypes[columns].tolist()
    as_rows = lambda f: sorted(map(tuple, f[columns].itertuples(index=False)))
    assert as_rows(got) == as_rows(want)
