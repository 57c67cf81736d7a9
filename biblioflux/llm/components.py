"""Connected components of pairwise matches by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import canonical_arxiv, canonical_doi, canonical_pmid, is_placeholder
from biblioflux.functions.text import py_strip
from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed

# Headings that name no work.
BARE_HEADINGS = [
    "abstract", "abstracts", "acknowledgements", "acknowledgments", "addendum", "advertisement", "announcement", "announcements", "appendix",
    "author correction", "author index", "back cover", "back matter", "book review", "book reviews", "case report", "comment", "commentary",
    "comments", "conference abstracts", "contents", "correction", "corrections", "correspondence", "corrigenda", "corrigendum", "cover",
    "discussion", "editorial", "editorial board", "editors note", "errata", "erratum", "expression of concern", "foreword", "front cover",
    "front matter", "guest editorial", "highlights", "in brief", "in memoriam", "in this issue", "index", "interview", "introduction",
    "issue information", "letter", "letter to the editor", "letters", "letters to the editor", "masthead", "meeting abstracts", "news",
    "news and views", "note", "obituary", "opinion", "oral presentations", "perspective", "poster abstracts", "poster presentations",
    "preface", "proceedings", "publisher correction", "publishers note", "reply", "research highlights", "response", "retracted",
    "retraction", "retraction note", "review", "reviews", "reviewers", "subject index", "supplement", "table of contents", "title page",
    "untitled", "no title", "viewpoint", "withdrawal", "withdrawn",
]


def match_keys(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, kind, key) for every identifier by which a record can match others; placeholders and bare headings give none."""
    title = F.col("title_normalized")
    bare = F.lower(py_strip(title))
    named = F.when(~is_placeholder(title) & ~bare.isin(BARE_HEADINGS), title)
    kinds = {"doi": canonical_doi(F.col("doi")), "pmid": canonical_pmid(F.col("pmid")), "arxiv": canonical_arxiv(F.col("arxiv_id")), "title": named}
    keys = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.alias("key"))) for k, c in kinds.items()]))
    return df.select(row_id, F.explode(keys).alias("k")).select(row_id, "k.kind", "k.key")


def star_edges(keys: DataFrame, row_id: str) -> DataFrame:
    """(u, v), u > v: each row linked to the smallest row that has one of its keys; as many edges as keys at most, no pairs in groups."""
    hubs = keys.groupBy("kind", "key").agg(F.min(row_id).alias("v"), F.count("*").alias("n")).filter("n > 1")
    joined = join_aggregate(keys, checkpointed(hubs), ["kind", "key"], "n")
    return joined.filter(F.col(row_id) > F.col("v")).select(F.col(row_id).alias("u"), "v").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): each edge beside the smallest neighbour of u."""
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
    return join_aggregate(edges, least, ["u"], "n").select("u", "v", "least")


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour v of u is linked to the smallest of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _with_least(both)
    return near.filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    ends = near.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return ends.filter("u > v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of a star or linked to one centre only: then nothing would change any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return seen.filter("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, group_id) for every node with an edge; group_id is the smallest node connected to it.

    ``edges`` has long columns u and v in any direction; loops, repeated edges and null ends are ignored. Each round is written to
    the shared checkpoint folder. Rounds grow with the logarithm of the longest path.
    """
    now = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    while not _are_stars(now):
        now = checkpointed(small_star(large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("group_id")).union(now.select(F.col("v").alias("node"), F.col("v").alias("group_id")).distinct())


def record_groups(df: DataFrame, row_id: str = "cluster_id") -> DataFrame:
    """(row_id, group_id) of every record in a group of two or more."""
    # read for the hubs and for the edges: the patterns that make them are costly, the keys are small
    keys = checkpointed(match_keys(df, row_id).distinct())
    return components(star_edges(keys, row_id)).select(F.col("node").alias(row_id), "group_id")
