"""Golden records per cluster and preprint links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import is_preprint_doi
from biblioflux.functions.text import normalize_doi
from biblioflux.schema import DB_PRIORITY, OTHER_PRIORITY


def priority(c: Column) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for db, k in DB_PRIORITY.items():
        out = F.when(c == db, k).otherwise(out)
    return out


def _present(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def survivors(clustered: DataFrame) -> DataFrame:
    """One golden record per cluster_id of records with ``ord``.

    The representative has a published DOI, else any DOI, then the database of highest priority, the longer abstract, the earlier
    position. The abstract is the longest of the cluster (the earliest of equal length); doi, pmid and arxiv_id are the earliest
    ones, a published DOI before a preprint. Everything is one aggregation with partial sums, so a huge cluster doesn't gather in
    one task; its sets of sources and DOIs are part of the result.
    """
    pre = is_preprint_doi(F.col("doi_normalized"))
    has = F.coalesce(F.col("doi_normalized") != "", F.lit(False))
    length = F.length(F.coalesce("abstract", F.lit("")))
    order = F.struct(F.when(has & ~pre, 1).otherwise(2), F.when(has, 1).otherwise(2), priority(F.col("source_db")), -length, F.col("ord"))
    best = F.struct("title_original", "title_normalized", "authors", "year", "venue", "date", "url")
    doi = _present("doi_original")
    raw_pre = is_preprint_doi(normalize_doi(doi))
    out = clustered.groupBy("cluster_id").agg(
        F.min_by(best, order).alias("best"),
        F.min_by(F.when(length > 0, F.col("abstract")), F.when(length > 0, F.struct(-length, F.col("ord")))).alias("longest"),
        F.min_by(F.when(~raw_pre, doi), F.when(doi.isNotNull() & ~raw_pre, F.col("ord"))).alias("published"),
        F.min_by(F.when(raw_pre, doi), F.when(doi.isNotNull() & raw_pre, F.col("ord"))).alias("preprint"),
        F.min_by(_present("pmid"), F.when(F.col("pmid") != "", F.col("ord"))).alias("pmid"),
        F.min_by(_present("arxiv_id_original"), F.when(F.col("arxiv_id_original") != "", F.col("ord"))).alias("arxiv_id"),
        F.array_sort(F.collect_set("source_db")).alias("sources"),
        F.array_sort(F.collect_set(doi)).alias("all_dois"),
        F.count("*").alias("duplicate_count"),
    )
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("pmid", "arxiv_id")}
    return out.select(
        "cluster_id", F.col("best.title_original").alias("title"), "best.title_normalized", F.coalesce("published", "preprint", F.lit("")).alias("doi"),
        F.when(F.col("published").isNotNull() & F.col("preprint").isNotNull(), F.col("preprint")).otherwise("").alias("preprint_doi"),
        text["pmid"].alias("pmid"), text["arxiv_id"].alias("arxiv_id"), F.coalesce("longest", F.lit("")).alias("abstract"),
        "best.authors", "best.year", "best.venue", "best.date", "best.url", "sources", F.size("sources").cast("long").alias("n_sources"), "all_dois", "duplicate_count",
    )


def preprint_links(clustered: DataFrame) -> DataFrame:
    """(cluster_id, published_doi, preprint_dois, title) of clusters of two or more records that have DOIs of both kinds.

    preprint_dois keeps repeats, in record order; published_doi is the earliest one; title is the founder's.
    """
    doi = F.when(F.col("doi_normalized") != "", F.col("doi_normalized"))
    pre = is_preprint_doi(doi)
    out = clustered.groupBy("cluster_id").agg(
        F.min_by(F.when(~pre, doi), F.when(doi.isNotNull() & ~pre, F.col("ord"))).alias("published_doi"),
        F.array_sort(F.collect_list(F.when(pre, F.struct("ord", F.col("doi_normalized").alias("doi"))))).alias("pairs"),
        F.min_by(F.left("title_original", F.lit(100)), "ord").alias("title"),
        F.count("*").alias("n"),
    )
    out = out.filter("n > 1 AND published_doi IS NOT NULL AND size(pairs) > 0")
    return out.select("cluster_id", "published_doi", F.col("pairs.doi").alias("preprint_dois"), "title")
