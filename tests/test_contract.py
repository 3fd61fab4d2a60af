"""Every query with SQL gives what DuckDB gives; the entry point works with and without optional parts."""

import os

import duckdb
import pytest

import __spark_entry__
from shoal import oracle
from shoal import queries as library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs() < 1e-9).all() | (a[c].isna() == b[c].isna()).all(), c
            assert ((a[c] - b[c]).abs().fillna(0) < 1e-9).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, duck, name):
    same(library.REGISTRY[name](spark, SF).toPandas(), duck.execute(oracle.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(library.REGISTRY) - set(oracle.SQL)))
def test_runs_without_sql(spark, name):
    df = library.REGISTRY[name](spark, SF)
    assert df.count() >= 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(library.REGISTRY) <= set(__spark_entry__.queries())
    assert set(oracle.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
