"""Filters and per-key picks used while records are gathered."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflux.functions.text import py_strip
from biblioflux.schema import MIN_ABSTRACT


def has_abstract(c: Column) -> Column:
    return F.coalesce(F.length(py_strip(c)) > MIN_ABSTRACT, F.lit(False))


def within_cutoff(date: Column, cutoff: str) -> Column:
    """A date of variable precision against an upper bound YYYY-MM-DD; true for a missing date and a year that isn't a number."""
    year = F.try_to_number(date, F.lit("9999")).cast("int")
    return (
        F.when(F.coalesce(date, F.lit("")) == "", True)
        .when(F.length(date) == 4, F.when(date.rlike(r"^\s*[+-]?\d+\s*$"), year <= int(cutoff[:4])).otherwise(True))
        .when(F.length(date) == 7, date <= cutoff[:7])
        .otherwise(F.left(date, F.lit(10)) <= cutoff)
    )


def in_compact_range(date: Column, low: str, high: str) -> Column:
    """Whether the first eight digits of a date lie in [low, high]; true for a missing date."""
    compact = F.left(F.replace(date, F.lit("-"), F.lit("")), F.lit(8))
    return F.when(F.coalesce(date, F.lit("")) == "", True).otherwise(compact.between(low, high))


def all_blocks(text: Column, patterns: list[str]) -> Column:
    """Whether every pattern occurs somewhere in the text, in any case."""
    out = F.lit(True)
    for p in patterns:
        re.compile(p)
        out = out & text.rlike(f"(?iud){p}")
    return F.coalesce(out, F.lit(False))


def first_wins(df: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of every key; rows without a key are dropped. One aggregation with partial results, no window."""
    rest = [c for c in df.columns if c != key]
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def last_wins_first_place(df: DataFrame, key: str, order: list[str], place: str) -> DataFrame:
    """The last row of every key with ``place``, the order of the key's first row."""
    rest = [c for c in df.columns if c != key]
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.min(F.struct(*order)).alias("__p"))
    return picked.select(key, "r.*", F.col(f"__p.{order[0]}").alias(place))


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key doesn't occur in ``seen``; rows without a key are dropped."""
    return df.filter(F.col(key).isNotNull()).join(seen.select(key).distinct(), key, "left_anti")


def first_k(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of every key. Spark keeps k rows per key in each task before the shuffle, so a hot key moves few rows."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def first_missing(df: DataFrame, abstract: str, order: str, n: int = 0) -> DataFrame:
    """The first n rows without an abstract by position; all of them for n = 0."""
    missing = df.filter(~has_abstract(F.col(abstract)))
    return missing.orderBy(order).limit(n) if n else missing
