"""Surviving fields of the record groups: preferences of each field, settled by the consensus operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import canonical_doi, is_placeholder, is_preprint_doi
from biblioflux.llm.components import record_groups
from biblioflux.llm.survivors import best_values
from biblioflux.llm.truncation import cut_records, is_no_text
from biblioflux.session import checkpointed, written


#: Votes of a whole abstract, a published DOI or the full name of a venue beside one of the others.
TRUSTED = 4


def venue_key(c: Column) -> Column:
    """A venue's name without case, spacing and punctuation, "&" read as "and"."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "&(?:amp;)?", "and"), r"[^\p{L}\p{N}]+", "")


def venue_ranks(venues: DataFrame) -> DataFrame:
    """(venue_key, level): 0 full name of a journal or conference, 1 its abbreviation, 2 preprint server; the best level of a key."""
    server = F.col("venue_type") == "preprint server"
    names = venues.select(venue_key(F.col("venue_name")).alias("venue_key"), F.when(server, 2).otherwise(0).alias("level"))
    short = venues.select(venue_key(F.col("venue_abbrev")).alias("venue_key"), F.when(server, 2).otherwise(1).alias("level"))
    return names.union(short).filter("venue_key <> ''").groupBy("venue_key").agg(F.min("level").alias("level"))


def surviving_fields(records: DataFrame, venues: DataFrame) -> DataFrame:
    """(group_id, field, kept) for the groups of records linked by their identifiers.

    ``kept`` is the cluster_id whose abstract, doi or venue survives, or for ``sources`` one row per database. A field without any
    value in the group gives no row; ties go to the smallest cluster_id. A venue that the reference list doesn't know ranks last.
    """
    wanted = records.select("cluster_id", "title_normalized", "doi", "pmid", "arxiv_id", "abstract", "abstract_source", "venue", "sources")
    groups = checkpointed(record_groups(wanted))
    members = written(wanted.join(groups, "cluster_id").select("group_id", "cluster_id", "doi", "abstract", "abstract_source", "venue", "sources"))

    cut = cut_records(wanted, "cluster_id", "abstract", "abstract_source", judged=members).select("cluster_id", "is_cut")
    ranks = venue_ranks(venues)
    letters = F.length(F.regexp_replace("abstract", r"[^\p{L}\p{N}]+", ""))
    abstract = F.when(~is_no_text(F.col("abstract")), F.struct(F.lit("abstract").alias("field"), F.col("abstract").alias("text"), F.col("is_cut").cast("int").alias("level"), (-letters).alias("less")))
    doi = canonical_doi(F.col("doi"))
    doi = F.when(doi.isNotNull(), F.struct(F.lit("doi").alias("field"), doi.alias("text"), is_preprint_doi(doi).cast("int").alias("level"), F.lit(0).alias("less")))
    named = ~is_placeholder(F.col("venue")) & (F.col("venue_key") != "")
    venue = F.when(named, F.struct(F.lit("venue").alias("field"), F.col("venue_key").alias("text"), F.coalesce("level", F.lit(3)).alias("level"), F.lit(0).alias("less")))
    # the reference list is joined as Spark sees fit: it is broadcast only below the session's size threshold
    rich = members.withColumn("venue_key", venue_key(F.col("venue"))).join(ranks, "venue_key", "left").join(cut, "cluster_id")
    values = rich.select("group_id", "cluster_id", F.explode(F.array_compact(F.array(abstract, doi, venue))).alias("v")).select("group_id", "cluster_id", "v.*")
    # an abstract is corroborated by each record that has it; identifiers and names are single tokens, of which copies prove nothing
    trust = F.when(F.col("level") == 0, TRUSTED).otherwise(1)
    order = [F.col("less"), F.col("cluster_id")]
    kept = best_values(values, ["group_id", "field"], "cluster_id", "text", F.col("level"), trust, order, F.col("field") == "abstract")
    sources = members.select("group_id", F.explode("sources").alias("kept")).filter(~is_placeholder(F.col("kept"))).distinct()
    return sources.select("group_id", F.lit("sources").alias("field"), "kept").unionByName(
        kept.select("group_id", "field", F.col("cluster_id").cast("string").alias("kept"))
    )
