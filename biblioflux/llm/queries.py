"""Registry of this subpackage's queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.llm.components import record_groups
from biblioflux.llm.format_duplicates import canonical_key, copy_groups
from biblioflux.llm.leakage import leaks
from biblioflux.llm.lookalikes import consistent
from biblioflux.llm.packing import pack_documents, token_counts
from biblioflux.llm.record_survivors import surviving_fields
from biblioflux.llm.sql import P2_FOUND, P6_FOUND, P9_STATS
from biblioflux.llm.text_quality import text_forms, text_rules
from biblioflux.llm.truncation import cut_records, cut_shares, is_no_text
from biblioflux.session import checkpointed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"p2_found": P2_FOUND, "p6_found": P6_FOUND, "p9_stats": P9_STATS}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "title", "doi")
    groups = copy_groups(records, "cluster_id", canonical_key(F.col("title"), F.col("doi")))
    return groups.filter("cluster_id <> first_id").select("first_id", F.col("cluster_id").alias("copy_id"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "doi", "pmid", "arxiv_id", "title_normalized")
    return record_groups(records)


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_fields(table(spark, sf_dir, "deduplicated_records"), table(spark, sf_dir, "venues"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_records(table(spark, sf_dir, "deduplicated_records"), "cluster_id", "abstract", "abstract_source")
    return cut.filter("is_cut").select("cluster_id", "abstract_source")


@query
def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a null source is a group of its own; what is no text counts for none
    records = table(spark, sf_dir, "deduplicated_records").filter(~is_no_text(F.col("abstract")))
    return cut_shares(cut_records(records, "cluster_id", "abstract", "abstract_source"), "abstract_source")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "title", "authors")
    return consistent(records, ["title", "authors"]).select("cluster_id", F.explode("changed").alias("field"))


@query
def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "title", "authors")
    return consistent(records, ["title", "authors"]).select("cluster_id", "title", "authors")


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forms = text_forms(docs, "text", table(spark, sf_dir, "common_words"))
    return forms.filter("form <> 'prose'").select("doc_id", "form")


@query
def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ruled = text_rules(docs, "text", table(spark, sf_dir, "common_words"))
    rounded = {s: F.round(s, 6) for s, kind in ruled.dtypes if kind == "double"}
    return ruled.drop("text").withColumns(rounded).withColumn("reasons", F.array_join("reasons", "; "))


@query
def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forms = text_forms(docs, "text", table(spark, sf_dir, "common_words")).select("doc_id", "form", "reasons", "junk_reasons")
    return forms.withColumn("reasons", F.array_join("reasons", "; ")).withColumn("junk_reasons", F.array_join("junk_reasons", "; "))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


@query
def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = checkpointed(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack_documents(counts, "doc_id", "n_tokens", table(spark, sf_dir, "pack_sizes"), "pack_size_id", "capacity_tokens")


@query
def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir)


@query
def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = _packs(spark, sf_dir).groupBy("pack_size_id", "pack_id").agg(F.sum("n_tokens").alias("n_tokens"))
    per_size = packs.groupBy("pack_size_id").agg(F.count("*").alias("n_packs"), F.sum("n_tokens").alias("n_tokens"))
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_size_id", "capacity_tokens")
    return per_size.join(sizes, "pack_size_id").withColumn("room_share", 1 - F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")))
