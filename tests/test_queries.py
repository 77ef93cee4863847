"""Every registered query of the engine against its SQL, as the driver compares them."""

import math
from datetime import datetime

import duckdb
import pytest

import __spark_entry__
from structcast.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rel = db.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [[plain(r[rel.columns.index(c)]) for c in columns] for r in rel.fetchall()]
    have = [[plain(r[c]) for c in columns] for r in got.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
