"""Duplicates hidden by formatting: Bloom filters of once- and repeatedly-seen hashes keep unique records out of the shuffle.

Rows are kept by ranges of their hash, each with a filter of its own: the bits grow in proportion to the rows, a task holds the filter of
one range at a time, and no machine ever holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import canonical_doi, is_placeholder
from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed, own_folder

#: Rows of a hash range, on average; with BITS_PER_ROW (up to twice as many, as bits are a power of two) the filter of a range has at
#: most 128 MiB.
ROWS_PER_RANGE = 1 << 25
BITS_PER_ROW = 16
PROBES = 4
#: Unit of merging: a power of two of bits.
SEGMENT_BITS = 1 << 19


def canonical_key(title: Column, doi: Column) -> Column:
    """One text for title and DOI with their formatting set aside, also where the two fields are exchanged; null without a title.

    Of the title only letters and digits count, in lower case. The DOI loses its spelling; one that can't be read as a DOI counts
    by its letters and digits, and a missing one (or a placeholder) is ''.
    """

    def plain(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")

    t, d = F.coalesce(title, F.lit("")), F.coalesce(doi, F.lit(""))
    looks = r"(?i)^\W*(?:(?:https?://|doi\b|www\.)\S*?\s*:?\s*)?10\.\d{4,9}\s*(?:/|%2F)\s*\S+\s*$"
    exchanged = t.rlike(looks) & ~d.rlike(looks)
    work, number = F.when(exchanged, d).otherwise(t), F.when(exchanged, t).otherwise(d)
    name = F.when(is_placeholder(work), "").otherwise(plain(work))
    ident = F.when(is_placeholder(number), "").otherwise(F.coalesce(canonical_doi(number), plain(number)))
    return F.when(name != "", F.concat(name, F.lit("\x1f"), ident))


def filter_bits(rows: int) -> int:
    """Bits of a range's filter for so many rows: the least power of two with BITS_PER_ROW for each."""
    return 1 << max(12, (max(rows, 1) * BITS_PER_ROW - 1).bit_length())


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions per 64-bit hash (double hashing), shape (len, PROBES)."""
    h = hashes.astype(np.uint64)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    mixed = (a[:, None] + steps * b[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)) & np.uint64(bits - 1)


def _encode(at: np.ndarray, segment_bits: int) -> bytes:
    """Positions within a segment: as a list, or as bits where that is shorter."""
    if 32 * len(at) < segment_bits:
        return b"l" + at.astype("<u4").tobytes()
    flags = np.zeros(segment_bits, dtype=np.uint8)
    flags[at] = 1
    return b"b" + np.packbits(flags).tobytes()


def _decode(part: bytes) -> np.ndarray:
    if part[:1] == b"l":
        return np.frombuffer(part, dtype="<u4", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(part, dtype=np.uint8, offset=1)))


def repeat_filters(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """(range, segment, again): the packed bits that two or more rows of a range set; segments without such a bit are left out.

    ``hashes`` has a column ``range`` besides. Each task counts its own rows into (once, repeatedly) and emits the touched segments;
    merging two pairs is (o1 | o2, r1 | r2 | o1 & o2), which is associative, so the parts of a segment merge in any order.
    """
    segment_bits = min(bits, SEGMENT_BITS)
    per_range = bits // segment_bits

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task counts half a million rows at a time, which bounds its memory
        held: list[np.ndarray] = []
        count = 0

        def flush() -> Iterator[pd.DataFrame]:
            at = np.concatenate(held)
            # probes of one row that fall together count once
            at.sort(axis=1)
            first = np.ones(at.shape, dtype=bool)
            first[:, 1:] = at[:, 1:] != at[:, :-1]
            spots, n = np.unique(at[first], return_counts=True)
            segment, local = (spots // np.uint64(segment_bits)).astype(np.int64), (spots % np.uint64(segment_bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(segment)], strict=True):
                own, twice = local[a:b], local[a:b][n[a:b] > 1]
                yield pd.DataFrame({"range": [segment[a] // per_range], "segment": [segment[a] % per_range], "once": [_encode(own, segment_bits)], "again": [_encode(twice, segment_bits)]})

        for pdf in batches:
            at = positions(pdf[column].to_numpy(dtype=np.int64), bits)
            held.append(at + pdf["range"].to_numpy(dtype=np.uint64)[:, None] * np.uint64(bits))
            count += len(pdf)
            if count >= 500_000:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again = (np.zeros(segment_bits, dtype=np.uint8) for _ in range(2))
        for o, r in zip(pdf["once"], pdf["again"], strict=True):
            o = _decode(o)
            again[o] |= once[o]
            again[_decode(r)] = 1
            once[o] = 1
        out = pd.DataFrame({"range": [pdf["range"].iloc[0]], "segment": [pdf["segment"].iloc[0]], "again": [np.packbits(again).tobytes()]})
        return out if again.any() else out.iloc[:0]

    parts = hashes.select("range", column).mapInPandas(partial, "range long, segment long, once binary, again binary")
    return parts.groupBy("range", "segment").applyInPandas(merge, "range long, segment long, again binary")


def _filter_at(uri: str, bits: int, segment_bits: int) -> np.ndarray:
    """The packed filter of one range from its table in the shared folder; one without repeated bits has no folder."""
    if uri.startswith("file:"):
        fs, path = pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    elif "://" in uri:
        fs, path = pafs.FileSystem.from_uri(uri)
    else:
        fs, path = pafs.LocalFileSystem(), uri
    out = np.zeros(bits // 8, dtype=np.uint8)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        width = segment_bits // 8
        for row in pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["segment", "again"]).to_pylist():
            out[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["again"], dtype=np.uint8)
    return out


def marked_rows(df: DataFrame, row_id: str, key: Column) -> DataFrame:
    """(row_id, __key, __again) for every row: whether its key's hash may have been seen twice; false for a null key."""
    spark = df.sparkSession
    # the canonical keys serve the filter and the probe: written once to the shared folder, by hash range and without a shuffle
    rows = df.count()
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    bits = filter_bits(-(-rows // ranges))
    segment_bits = min(bits, SEGMENT_BITS)
    folder = own_folder(spark, "copies")
    keyed = df.select(F.col(row_id), key.alias("__key")).withColumn("__hash", F.xxhash64("__key"))
    keyed = keyed.withColumn("hash_range", F.when(F.col("__key").isNotNull(), F.pmod(F.shiftrightunsigned("__hash", 40), F.lit(ranges))).otherwise(-1).cast("int"))
    keyed.write.partitionBy("hash_range").parquet(f"{folder}/keys")
    kept = spark.read.schema(keyed.schema).parquet(f"{folder}/keys")
    repeat_filters(kept.filter("hash_range >= 0").withColumnRenamed("hash_range", "range"), "__hash", bits).write.partitionBy("range").parquet(f"{folder}/filters")

    def probe(part: DataFrame, uri: str) -> DataFrame:
        held: list[np.ndarray] = []

        def maybe_again(h: pd.Series) -> pd.Series:
            if not held:
                held.append(_filter_at(uri, bits, segment_bits))
            at = positions(h.to_numpy(dtype=np.int64), bits)
            byte = held[0][(at >> np.uint64(3)).astype(np.int64)]
            return pd.Series(((byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1))

        return part.select(row_id, "__key", F.pandas_udf(maybe_again, "boolean")("__hash").alias("__again"))

    # a scan for each range, so that a task reads the filter of one range only
    out = kept.filter("hash_range = -1").select(row_id, "__key", F.lit(False).alias("__again"))
    for r in range(ranges):
        out = out.unionByName(probe(kept.filter(F.col("hash_range") == r), f"{folder}/filters/range={r}"))
    return out


def copy_groups(df: DataFrame, row_id: str, key: Column) -> DataFrame:
    """(row_id, first_id, n_copies) for every row of ``df``; first_id is the smallest id of rows with an equal key.

    Rows whose hash can't have been seen twice are emitted as singletons without a shuffle. Rows with a null key are singletons.
    The filters only decide what is shuffled; groups are formed on the whole key, so the result is exact. Repeated ids count as
    separate rows. An empty table gives an empty table.
    """
    marked = marked_rows(df, row_id, key)
    possible = checkpointed(marked.filter("__again").select(row_id, "__key"))
    sets = checkpointed(possible.groupBy("__key").agg(F.min(row_id).alias("first_id"), F.count("*").alias("n_copies")))
    grouped = join_aggregate(possible, sets, ["__key"], "n_copies").select(row_id, "first_id", "n_copies")
    single = marked.filter(~F.col("__again")).select(row_id, F.col(row_id).alias("first_id"), F.lit(1).cast("long").alias("n_copies"))
    return grouped.unionByName(single)


def collapse_copies(df: DataFrame, row_id: str, key: Column) -> DataFrame:
    """(first_id, n_copies): one row per set of copies, singletons included."""
    return copy_groups(df, row_id, key).filter(F.col(row_id) == F.col("first_id")).select("first_id", "n_copies").distinct()
