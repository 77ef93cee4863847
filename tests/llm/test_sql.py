"""Queries with SQL against it."""

import duckdb
import pytest

from structcast.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(map(tuple, rel.fetchall()))
