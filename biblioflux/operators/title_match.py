"""Similar titles by word overlap, exact for a threshold, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.text import words_of
from biblioflux.session import checkpointed


def similar_titles(queries: DataFrame, rows: DataFrame, row_id: str, title: str, over: float = 0.8) -> DataFrame:
    """(query_id, row_id, similarity): rows whose word overlap |A∩B| / max(|A|, |B|) with a query's title is above ``over``.

    Words are ordered by rarity over ``rows``. Two sets of that overlap share a word among the first |A| - floor(over·|A|) of
    both, so only those are joined (a prefix filter: no link is lost); candidates are verified on the whole sets. Empty titles
    match nothing; a row doesn't match itself; rows of equal titles are joined once per distinct title.
    """

    def sets(df: DataFrame) -> DataFrame:
        return df.select(F.col(row_id).alias("id"), words_of(F.col(title)).alias("w")).filter(F.size("w") > 0)

    distinct = sets(rows).select(F.array_sort("w").alias("w"), "id")
    texts = checkpointed(distinct.groupBy("w").agg(F.count("*").alias("n")).select(F.xxhash64("w").alias("t"), "w"))
    asked = checkpointed(sets(queries).select(F.array_sort("w").alias("w"), "id"))
    frequency = texts.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.size("w").alias("n"), F.explode("w").alias("word")).join(frequency, "word", "left")
        ranked = words.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "word"))).alias("r"))
        keep = F.col("n") - F.floor(F.lit(over) * F.col("n")).cast("int")
        return ranked.select(key, F.explode(F.slice(F.col("r.word"), F.lit(1), F.greatest(keep, F.lit(1)))).alias("word"))

    asks = asked.select(F.xxhash64("w").alias("q"), "w").distinct()
    pairs = prefixes(asks, "q").join(prefixes(texts, "t"), "word").select("q", "t").distinct()
    sized = pairs.join(asks.select("q", F.col("w").alias("a")), "q").join(texts.select("t", F.col("w").alias("b")), "t")
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b"))
    near = sized.withColumn("similarity", share).filter(F.col("similarity") > over).select("q", "t", "similarity")
    hits = near.join(asked.select(F.xxhash64("w").alias("q"), F.col("id").alias("query_id")), "q")
    out = hits.join(distinct.select(F.xxhash64("w").alias("t"), F.col("id").alias(row_id)), "t")
    return out.filter(F.col("query_id") != F.col(row_id)).select("query_id", row_id, "similarity")
