import os

import duckdb
import pytest

from biblioflux.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    mine = queries.QUERIES[name](spark, DATA)
    assert sorted(map(tuple, mine.collect())) == sorted(c.sql(f"select {', '.join(mine.columns)} from ({queries.SQL[name]})").fetchall())


FOUND = {
    "p2_found": "first_id bigint, copy_id bigint", "p3_found": "cluster_id bigint, field string", "p4_found": "group_id bigint, field string, kept string",
    "p5_found": "cluster_id bigint, abstract_source string", "p6_found": "cluster_id bigint, group_id bigint", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint, form string",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns_of_found_queries(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) and all(v is not None for r in rows for c, v in r.asDict().items() if c != "abstract_source")
