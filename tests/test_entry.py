"""Every query with SQL gives the same rows as DuckDB on the smallest test data; those without give their columns."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module

from biblioflux import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, db, name):
    mine, other = core.QUERIES[name](spark, DATA).toPandas(), db.sql(core.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    as_text = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert as_text(mine) == as_text(other)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "cluster_id" in df.columns and df.count() > 0


def test_authors_of_whole_table(spark):
    got = core.QUERIES["p1_found"](spark, DATA)
    assert got.dtypes == [("cluster_id", "bigint"), ("pos", "bigint"), ("author", "string")]
    assert got.groupBy("cluster_id").agg({"pos": "max", "author": "count"}).filter("`max(pos)` <> `count(author)`").count() == 0


def test_core_stands_alone():
    """Nothing outside the subpackage imports it."""
    root = os.path.dirname(core.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "biblioflux.llm" not in open(os.path.join(folder, f), encoding="utf-8").read()
