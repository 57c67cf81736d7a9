"""Every query runs over empty tables and over tables with null rows, repeated rows and extra columns with clashing names."""

import os

import pytest
from pyspark.sql import functions as F

from biblioflux.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    for name in {f"{t}.parquet" for t in ("deduplicated_records", "documents", "eval_items", "venues", "common_words", "pack_sizes")}:
        df = spark.read.parquet(f"{DATA}/{name}")
        nulls = spark.range(3).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        odd = df.limit(40).union(nulls).union(df.limit(5)).withColumns({"first_id": F.lit("x"), "group_id": F.lit(1), "form": F.lit(0), "changed": F.lit("y"), "is_cut": F.lit(2)})
        odd.write.parquet(f"{full}/{name}")
        df.limit(0).write.parquet(f"{empty}/{name}")
    return str(full), str(empty)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, odd_tables, name):
    for folder in odd_tables:
        queries.QUERIES[name](spark, folder).collect()
