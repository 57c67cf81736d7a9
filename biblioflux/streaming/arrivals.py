"""Streams of arriving records: windowed counts with late data, first-wins deduplication, incremental key registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.operators.filters import first_wins


def counts_by_window(stream: DataFrame, ts: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, by, n) of an unbounded or bounded table; rows later than ``late`` behind the newest are dropped on a stream."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    counts = marked.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), by, "n")


def first_arrivals(stream: DataFrame, key: str, ts: str, within: str = "30 days") -> DataFrame:
    """The first row of each key; a stream forgets a key after ``within``, which bounds its state. Rows without a key are dropped.

    A table's first row is the one of the least ``ts``, a row without it coming last, and any of several at the same time; a
    stream's is the one that arrives first."""
    keyed = stream.filter(F.col(key).isNotNull())
    if stream.isStreaming:
        return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return first_wins(keyed, key, [F.col(ts).isNull(), F.col(ts)]).select(*stream.columns)


def append_new_keys(read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], key: str, first: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that registers the earliest holder of every key that isn't registered yet.

    ``read`` gives the register so far (key, first) or None, and ``write(rows, batch)`` stores the new ones under the batch's
    number, so that a batch that is run again replaces its own rows. A registered holder never changes.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = batch.filter((F.col(key) != "") & F.col(key).isNotNull()).groupBy(key).agg(F.min(first).alias(first))
        known = read()
        write(new if known is None else new.join(known.select(key), key, "left_anti"), number)

    return run
