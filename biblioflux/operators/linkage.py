"""Order-dependent, priority-keyed record linkage: earliest key holders, pointer jumping, decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.operators.positions import with_positions
from biblioflux.operators.skew import join_aggregate
from biblioflux.schema import DB_ORDER
from biblioflux.session import checkpointed

#: Keys by falling priority, with the text of the reason; the last one doesn't name its value.
KEYS = [("doi_normalized", "DOI match: "), ("pmid", "PMID match: "), ("arxiv_id_normalized", "arXiv ID match: "), ("title_normalized", "Exact title match")]


def db_rank(c: Column) -> Column:
    """Position of a database in the processing order; unknown ones come last."""
    out = F.lit(len(DB_ORDER))
    for k, db in enumerate(DB_ORDER):
        out = F.when(c == db, k).otherwise(out)
    return out


def in_order(records: DataFrame) -> DataFrame:
    """Records with ``ord``, their position by database order and record_id; a row delivered twice has two positions, and rows of one
    id that differ in their keys stand in a fixed order."""
    placed = records.withColumns({"db_rank": db_rank(F.col("source_db")), "__tie": F.xxhash64(*[c for c, _ in KEYS])})
    return with_positions(placed, ["db_rank", "record_id", "__tie"], "ord").drop("db_rank", "__tie")


def link(records: DataFrame) -> DataFrame:
    """(ord, root, reason, cluster_id) for records with a total order ``ord``.

    A record joins the cluster of the earliest record that holds its first key with an earlier holder, in the priority of KEYS;
    clusters never merge later. ``records`` are read several times and should be kept, as in_order keeps them. ``root`` is the founder's ord, ``cluster_id`` the 0-based rank of the founder, ``reason`` names
    the deciding key. Null and empty keys match nothing; an empty table gives an empty table.
    """
    entries = [
        F.when(F.col(c) != "", F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), (F.concat(F.lit(text), F.col(c)) if k < 3 else F.lit(text)).alias("why")))
        for k, (c, text) in enumerate(KEYS)
    ]
    keys = records.select("ord", F.explode(F.array_compact(F.array(*entries))).alias("k")).select("ord", "k.*")
    # in these joins one side has a single row per key, and the rows of a hot key on the other are split by the adaptive skew join
    first = keys.groupBy("kind", "key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    earlier = keys.join(first, ["kind", "key"]).filter("first < ord")
    best = earlier.groupBy("ord").agg(F.min_by(F.struct("first", "why"), "kind").alias("b")).select("ord", "b.first", "b.why")
    now = records.select("ord").join(best, "ord", "left")
    now = checkpointed(now.select("ord", F.coalesce("first", "ord").alias("root"), F.coalesce("why", F.lit("No match found")).alias("reason")))
    while True:
        ups = now.filter("root <> ord").select(F.col("ord").alias("hub"), F.col("root").alias("up"))
        now = checkpointed(now.join(ups, F.col("root") == F.col("hub"), "left").select("ord", F.coalesce("up", "root").alias("root"), "reason", F.col("up").isNotNull().alias("moved")))
        settled = now.filter("moved").isEmpty()
        now = now.drop("moved")
        if settled:
            break
    ids = with_positions(now.filter("root = ord").select(F.col("ord").alias("root")), ["root"], "cluster_id")
    return now.join(ids, "root").select("ord", "root", "reason", "cluster_id")


def decision_log(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: action, reason, cluster_id, source_db, title, doi, and the founder's database and title."""
    joined = records.join(links, "ord")
    founders = joined.filter("root = ord").select("root", F.col("source_db").alias("f_db"), F.left("title_original", F.lit(100)).alias("f_title"))
    sizes = links.groupBy("root").agg(F.count("*").alias("n"))
    founders = checkpointed(founders.join(sizes, "root"))
    merged = F.col("root") != F.col("ord")
    return join_aggregate(joined, founders, ["root"], "n").select(
        "record_id", F.when(merged, "MERGE").otherwise("NEW").alias("action"), "reason", "cluster_id", "source_db",
        F.left("title_original", F.lit(100)).alias("title"), F.col("doi_original").alias("doi"),
        F.when(merged, F.col("f_db")).otherwise("").alias("matched_with_db"), F.when(merged, F.col("f_title")).otherwise("").alias("matched_with_title"),
    )
