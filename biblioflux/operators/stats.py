"""Counts, rates, overlap of sources and recall of known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_with_total(df: DataFrame, by: str, total: str = "TOTAL") -> DataFrame:
    """(by, n) with a total row; a null group is named 'unknown'. One pass through a rollup."""
    named = df.select(F.coalesce(by, F.lit("unknown")).alias(by))
    return named.rollup(by).agg(F.count("*").alias("n")).select(F.coalesce(by, F.lit(total)).alias(by), "n")


def duplicate_rate(before: int | Column, after: int | Column) -> Column:
    """Percentage removed, to one decimal; null for an empty input."""
    before, after = (F.lit(x) if isinstance(x, int) else x for x in (before, after))
    return F.round(F.try_divide((before - after) * F.lit(100.0), before), 1)


def reason_counts(log: DataFrame) -> DataFrame:
    """(reason, n) of merges by the kind of key, which is the reason up to the colon."""
    kind = F.split_part("reason", F.lit(":"), F.lit(1))
    return log.filter("action = 'MERGE'").groupBy(kind.alias("reason")).agg(F.count("*").alias("n"))


def source_distribution(golden: DataFrame) -> DataFrame:
    return golden.groupBy("n_sources").agg(F.count("*").alias("n_records"))


def source_overlap(golden: DataFrame) -> DataFrame:
    """(source_a, source_b, n): records found in both, a before b. Pairs are of the sources of one record, a set bounded by the
    number of databases, and are summed before the shuffle."""
    pairs = F.flatten(F.transform("sources", lambda a: F.transform(F.filter("sources", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return golden.select(F.inline(pairs)).groupBy(F.col("a").alias("source_a"), F.col("b").alias("source_b")).agg(F.count("*").alias("n"))


def name_matrix(records: DataFrame, names: list[str], text: Column, by: str) -> DataFrame:
    """(name, by, n): records whose text holds a name anywhere in any case, zero-filled over the groups that occur. The names are
    a short list given by the caller; texts are read once, whatever their number."""
    low = F.lower(text)
    hits = [F.count_if(F.coalesce(F.contains(low, F.lit(x.lower())), F.lit(False))).alias(f"n{k}") for k, x in enumerate(names)]
    counts = records.groupBy(by).agg(*hits)
    rows = F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"n{k}").alias("n")) for k, x in enumerate(names)])
    return counts.select(by, F.inline(rows)).select("name", by, "n")


def name_recall(records: DataFrame, names: list[str], text: Column) -> DataFrame:
    """(name, n_found, found) over all records."""
    matrix = name_matrix(records.select(text.alias("__t")).withColumn("__all", F.lit(1)), names, F.col("__t"), "__all")
    return matrix.select("name", F.col("n").alias("n_found"), (F.col("n") > 0).alias("found"))
