"""Missing abstracts from a waterfall of providers, and the split by presence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.text import py_strip, strip_tags
from biblioflux.operators.filters import has_abstract
from biblioflux.operators.title_match import similar_titles
from biblioflux.session import checkpointed


def waterfall(records: DataFrame, stages: list[tuple[str, DataFrame | Callable[[DataFrame], DataFrame], str]], row_id: str = "cluster_id") -> DataFrame:
    """``records`` with ``abstract`` filled and ``abstract_source`` naming who delivered it (null where nobody did or it was there).

    ``stages`` are (name, provider with one row per key and a column ``found``, key column), tried in this order; a record asks a
    stage only while it misses an abstract, so each join carries fewer rows than the one before; what a stage was asked is kept in
    the shared folder, so that no stage is run again for the ones behind it. A provider may be a function of the records that still
    miss an abstract; stages may share a name. Records without the stage's key pass it by. A provider's
    null or empty ``found`` counts as no answer.
    """
    there = has_abstract(F.col("abstract"))
    done = [records.filter(there).withColumn("abstract_source", F.lit(None).cast("string"))]
    missing = records.filter(~there)
    for name, provider, key in stages:
        provider = provider if isinstance(provider, DataFrame) else provider(missing)
        answers = provider.select(F.col(key).alias("__key"), F.col("found").alias("__found")).filter("__key <> '' AND __found <> ''")
        keyed = F.coalesce(F.col(key) != "", F.lit(False))
        asked = missing.filter(keyed).join(answers, F.col(key) == F.col("__key"), "left").drop("__key")
        asked = checkpointed(asked.unionByName(missing.filter(~keyed).withColumn("__found", F.lit(None).cast("string"))))
        got = asked.filter("__found is not null")
        done.append(got.withColumn("abstract", F.col("__found")).drop("__found").withColumn("abstract_source", F.lit(name)))
        missing = asked.filter("__found is null").drop("__found")
    done.append(missing.withColumn("abstract_source", F.lit(None).cast("string")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def by_doi(provider: DataFrame, key: str = "doi_key", tags: bool = False) -> DataFrame:
    """One stripped answer per key: the least text longer than the minimum; ``tags`` removes markup after the length was tested."""
    usable = provider.filter(has_abstract(F.col("abstract")) & (F.col(key) != ""))
    text = py_strip(strip_tags(F.col("abstract"))) if tags else py_strip(F.col("abstract"))
    return usable.groupBy(key).agg(F.min(text).alias("found"))


def by_similar_title(missing: DataFrame, provider: DataFrame, key: str, over: float = 0.8) -> DataFrame:
    """The answer for every title of ``missing`` from the most similar other title whose word overlap is above ``over``; the least
    title at equal overlap. Of several abstracts under that title the one counts that by_doi takes."""
    asked = missing.select(key).filter(F.col(key) != "").distinct()
    titles = provider.filter(has_abstract(F.col("abstract")) & (F.col(key) != "")).select(key).distinct()
    near = similar_titles(asked, titles, key, key, over)
    best = near.groupBy("query_id").agg(F.min_by(key, F.struct(-F.col("similarity"), F.col(key))).alias(key))
    return best.join(by_doi(provider, key), key).select(F.col("query_id").alias(key), "found")


def split_by_abstract(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records for screening, records excluded for want of an abstract with their exclusion_code)."""
    there = has_abstract(F.col("abstract"))
    return records.filter(there), records.filter(~there).withColumn("exclusion_code", F.lit("EC_NO_ABSTRACT"))
