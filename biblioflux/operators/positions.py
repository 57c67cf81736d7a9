"""Dense global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.session import checkpointed


def with_positions(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, … in the order of ``by``. Rows are range-partitioned and sorted; only one count per partition
    reaches the driver. Rows that tie get neighbouring positions in any order."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = checkpointed(ordered.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = {r["__part"]: r["count"] for r in ordered.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    starts = df.sparkSession.createDataFrame(offsets, "__part int, __start long")
    # one row per partition of the sort
    placed = ordered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row").bitwiseAND((1 << 33) - 1))
    return placed.drop("__part", "__row", "__start")
