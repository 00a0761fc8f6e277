"""Every registered query next to its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import normal
from plyforge.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    assert got == normal([d[0] for d in res.description], res.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 1 and "rouge_1" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
