"""Every registered query beside its SQL on the smallest test data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from presentia.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(str, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
