"""Joins of rows with per-key aggregates that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this counts as hot; at most rows / HOT_ROWS keys can be hot, which bounds what is broadcast.
HOT_ROWS = 200_000


def join_aggregate(rows: DataFrame, agg: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS, most: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``agg`` (``n`` = the rows of the key, on each of its lines; mostly there is one line per key).

    Rows of a hot key are spread over ceil(n / hot_rows) salts, and its lines in ``agg`` are repeated for each of them. The salt
    is a hash of the whole row, so that a task that runs again sends its rows to the same places.
    Null keys match nothing. ``agg`` is read up to three times, so it should be materialized. ``most`` is the largest ``n``, if the
    caller knows it.
    """
    if most is None:
        most = agg.agg(F.max(n)).first()[0] or 0
    if most <= hot_rows:
        return rows.join(agg, keys)
    hot = agg.filter(F.col(n) > hot_rows).select(*keys, F.ceil(F.col(n) / hot_rows).cast("int").alias("__salts")).distinct()
    salted = rows.join(F.broadcast(hot), keys, "left")
    salted = salted.withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__salts")).cast("int"))).drop("__salts")
    last = F.greatest(F.ceil(F.col(n) / hot_rows), F.lit(1)).cast("int") - 1
    spread = agg.withColumn("__salt", F.explode(F.sequence(F.lit(0), last)))
    return salted.join(spread, [*keys, "__salt"]).drop("__salt")
