"""Registry of the core queries: name -> callable(spark, sf_dir), and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import is_preprint_doi
from biblioflux.functions.text import first_non_empty, normalize_arxiv_id, normalize_doi, normalize_title, pubmed_text_abstract
from biblioflux.operators import enrichment, filters, linkage, stats, survivorship
from biblioflux.operators.packed_fields import split_packed
from biblioflux.operators.positions import with_positions
from biblioflux.operators.title_match import similar_titles
from biblioflux.plans.boolean import search
from biblioflux.plans.published import PUBLISHED
from biblioflux.session import checkpointed, table
from biblioflux.streaming.arrivals import counts_by_window, first_arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "authors", "sources")
    split = split_packed(records, "authors", F.array_join(F.array_sort("sources"), "+"), value="author")
    return split.select("cluster_id", "pos", "author")


# ---- normalization -----------------------------------------------------------------------------------------------------------

WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


@query(rf"""select record_id, {_strip("lower(regexp_replace(" + _strip("coalesce(doi_original, '')") + ", '^https?://(dx.)?doi.org/', '', 'i'))")} as doi
from unified_records""")
def doi_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unified_records").select("record_id", normalize_doi(F.col("doi_original")).alias("doi"))


@query(rf"select record_id, lower(regexp_replace({_strip("coalesce(arxiv_id_original, '')")}, 'v[0-9]+$', '')) as arxiv_id from unified_records")
def arxiv_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unified_records").select("record_id", normalize_arxiv_id(F.col("arxiv_id_original")).alias("arxiv_id"))


_TITLE = rf"regexp_replace(regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '<[^>]+>', '', 'g'), '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')"


@query(f"select cluster_id, {_strip(f"regexp_replace({_TITLE}, '[{WS}]+', ' ', 'g')")} as title from deduplicated_records")
def title_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "deduplicated_records").select("cluster_id", normalize_title(F.col("title")).alias("title"))


@query("""select 'golden' as kind, cluster_id as id, coalesce(nullif(doi, ''), nullif(preprint_doi, ''), '') as doi, coalesce(nullif(title, ''), '') as title,
 coalesce(nullif(url, ''), '') as url from deduplicated_records
union all select 'record', record_id, coalesce(nullif(doi_normalized, ''), nullif(doi_original, ''), ''), coalesce(nullif(title_original, ''), ''), coalesce(nullif(url, ''), '') from unified_records
union all select 'screened', record_id, coalesce(nullif(doi, ''), ''), coalesce(nullif(title, ''), ''), '' from screening_log""")
def unify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = table(spark, sf_dir, "deduplicated_records")
    source = table(spark, sf_dir, "unified_records")
    screened = table(spark, sf_dir, "screening_log")
    c = F.col
    parts = [
        golden.select(F.lit("golden").alias("kind"), c("cluster_id").alias("id"), first_non_empty(c("doi"), c("preprint_doi")).alias("doi"), first_non_empty(c("title")).alias("title"), first_non_empty(c("url")).alias("url")),
        source.select(F.lit("record").alias("kind"), c("record_id").alias("id"), first_non_empty(c("doi_normalized"), c("doi_original")).alias("doi"), first_non_empty(c("title_original")).alias("title"), first_non_empty(c("url")).alias("url")),
        screened.select(F.lit("screened").alias("kind"), c("record_id").alias("id"), first_non_empty(c("doi")).alias("doi"), first_non_empty(c("title")).alias("title")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return out.withColumn("url", F.coalesce("url", F.lit("")))


# ---- linkage -----------------------------------------------------------------------------------------------------------------

_RANK = "case source_db when 'pubmed' then 0 when 'scopus' then 1 when 'semantic_scholar' then 2 when 'biorxiv_medrxiv' then 3 when 'springernature' then 4 when 'arxiv' then 5 when 'google_scholar' then 6 else 7 end"
_LINKED = f"""with recursive placed as (select *, row_number() over (order by {_RANK}, record_id) - 1 as ord from unified_records),
held as (select *, min(ord) over (partition by doi_normalized) as d, min(ord) over (partition by pmid) as p, min(ord) over (partition by arxiv_id_normalized) as a,
  min(ord) over (partition by title_normalized) as t from placed),
parents as (select *, case when doi_normalized <> '' and d < ord then d when pmid <> '' and p < ord then p when arxiv_id_normalized <> '' and a < ord then a
    when title_normalized <> '' and t < ord then t end as parent,
  case when doi_normalized <> '' and d < ord then 'DOI match: ' || doi_normalized when pmid <> '' and p < ord then 'PMID match: ' || pmid
    when arxiv_id_normalized <> '' and a < ord then 'arXiv ID match: ' || arxiv_id_normalized when title_normalized <> '' and t < ord then 'Exact title match' else 'No match found' end as reason from held),
trees(ord, root) as (select ord, ord from parents where parent is null union all select c.ord, r.root from parents c join trees r on c.parent = r.ord),
ids as (select ord as root, row_number() over (order by ord) - 1 as cluster_id from parents where parent is null),
linked as (select p.*, r.root, i.cluster_id from parents p join trees r using (ord) join ids i using (root)) """


def _linked(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Records in order with their keys and the columns ``more``, and their links: what is put in order and kept is no wider than asked."""
    records = linkage.in_order(table(spark, sf_dir, "unified_records").select("record_id", "source_db", *(c for c, _ in linkage.KEYS), *more))
    return records, linkage.link(records)


def _clustered(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    records, links = _linked(spark, sf_dir, *more)
    return records.join(links, "ord")


@query(_LINKED + "select record_id, cluster_id::bigint as cluster_id, reason from linked")
def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).select("record_id", "cluster_id", "reason")


@query(_LINKED + """select l.record_id, case when l.root <> l.ord then 'MERGE' else 'NEW' end as action, l.reason, l.cluster_id::bigint as cluster_id, l.source_db,
 left(l.title_original, 100) as title, l.doi_original as doi, case when l.root <> l.ord then f.source_db else '' end as matched_with_db,
 case when l.root <> l.ord then left(f.title_original, 100) else '' end as matched_with_title from linked l join linked f on f.ord = l.root""")
def dedup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, links = _linked(spark, sf_dir, "title_original", "doi_original")
    return linkage.decision_log(records, checkpointed(links))


_PRE = "(@ like '10.1101/%' or @ like '10.48550/arxiv%')"
_SURVIVORS = f"""prepared as (select *, coalesce(doi_normalized <> '', false) as has, {_PRE.replace("@", "coalesce(doi_normalized, '')")} as pre,
  {_strip("lower(regexp_replace(" + _strip("coalesce(doi_original, '')") + ", '^https?://(dx.)?doi.org/', '', 'i'))")} as raw from linked),
scored as (select *, row_number() over (partition by cluster_id order by case when has and not pre then 1 else 2 end, case when has then 1 else 2 end,
  {_RANK},
  -length(coalesce(abstract, '')), ord) as best,
  row_number() over (partition by cluster_id order by case when coalesce(abstract, '') <> '' then 0 else 1 end, -length(coalesce(abstract, '')), ord) as longest from prepared),
golden as (select cluster_id, max(case when best = 1 then title_original end) as title, max(case when best = 1 then title_normalized end) as title_normalized,
  coalesce(arg_min(doi_original, ord) filter (doi_original <> '' and not {_PRE.replace("@", "raw")}), arg_min(doi_original, ord) filter (doi_original <> ''), '') as doi,
  case when count(*) filter (doi_original <> '' and not {_PRE.replace("@", "raw")}) > 0 then coalesce(arg_min(doi_original, ord) filter (doi_original <> '' and {_PRE.replace("@", "raw")}), '') else '' end as preprint_doi,
  coalesce(arg_min(pmid, ord) filter (pmid <> ''), '') as pmid, coalesce(arg_min(arxiv_id_original, ord) filter (arxiv_id_original <> ''), '') as arxiv_id,
  coalesce(max(case when longest = 1 then abstract end), '') as abstract, max(case when best = 1 then authors end) as authors, max(case when best = 1 then year end) as year,
  max(case when best = 1 then venue end) as venue, max(case when best = 1 then date end) as date, max(case when best = 1 then url end) as url,
  list_sort(list(distinct source_db)) as sources, count(distinct source_db) as n_sources,
  coalesce(array_to_string(list_sort(list(distinct doi_original) filter (doi_original <> '')), '|'), '') as all_dois, count(*) as duplicate_count from scored group by cluster_id) """


@query(_LINKED + "," + _SURVIVORS + """select cluster_id::bigint as cluster_id, title, title_normalized, doi, preprint_doi, pmid, arxiv_id, abstract, authors, year, venue, date, url,
 array_to_string(sources, '|') as sources, n_sources, all_dois, duplicate_count from golden""")
def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = ["title_original", "doi_original", "arxiv_id_original", "abstract", "authors", "year", "venue", "date", "url"]
    golden = survivorship.survivors(_clustered(spark, sf_dir, *more))
    return golden.withColumn("sources", F.array_join("sources", "|")).withColumn("all_dois", F.array_join("all_dois", "|"))


@query(_LINKED + f"""select cluster_id::bigint as cluster_id, arg_min(doi_normalized, ord) filter (doi_normalized <> '' and not {_PRE.replace("@", "doi_normalized")}) as published_doi,
 string_agg(doi_normalized, '|' order by ord) filter ({_PRE.replace("@", "doi_normalized")}) as preprint_dois, arg_min(left(title_original, 100), ord) as title from linked group by cluster_id
having count(*) > 1 and count(*) filter (doi_normalized <> '' and not {_PRE.replace("@", "doi_normalized")}) > 0 and count(*) filter ({_PRE.replace("@", "doi_normalized")}) > 0""")
def preprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.preprint_links(_clustered(spark, sf_dir, "title_original")).withColumn("preprint_dois", F.array_join("preprint_dois", "|"))


@query("select record_id, coalesce(doi_normalized like '10.1101/%' or doi_normalized like '10.48550/arxiv%', false) as is_preprint from unified_records")
def preprint_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unified_records").select("record_id", is_preprint_doi(F.col("doi_normalized")).alias("is_preprint"))


@query(f"select record_id, row_number() over (order by {_RANK}, record_id) - 1 as ord from unified_records")
def record_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("record_id", linkage.db_rank(F.col("source_db")).alias("db_rank"))
    return with_positions(records, ["db_rank", "record_id"], "ord").select("record_id", "ord")


# ---- statistics --------------------------------------------------------------------------------------------------------------


@query("select source_db, count(*) as n from unified_records group by 1 union all select 'TOTAL', count(*) from unified_records")
def records_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_with_total(table(spark, sf_dir, "unified_records"), "source_db")


@query(_LINKED + "select split_part(reason, ':', 1) as reason, count(*) as n from linked where root <> ord group by 1")
def merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = _linked(spark, sf_dir)
    return stats.reason_counts(links.select(F.when(F.col("root") != F.col("ord"), "MERGE").alias("action"), "reason"))


@query("select n_sources, count(*) as n_records from deduplicated_records group by 1")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_distribution(table(spark, sf_dir, "deduplicated_records"))


_OVERLAP = """with s as (select cluster_id, unnest(sources) as s from deduplicated_records), o as (select a.s as source_a, b.s as source_b, count(*) as n
 from s a join s b on a.cluster_id = b.cluster_id and a.s < b.s group by 1, 2) """


@query(_OVERLAP + "select * from o")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.source_overlap(table(spark, sf_dir, "deduplicated_records"))


@query(_OVERLAP + "select * from o order by n desc, source_a, source_b limit 10")
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_overlap(spark, sf_dir).orderBy(F.desc("n"), "source_a", "source_b").limit(10)


@query(_LINKED + """select count(*) as n_before, count(distinct root) as n_after, count(*) - count(distinct root) as n_removed,
 round((count(*) - count(distinct root)) * 100.0::double / count(*), 1) as duplicate_rate from linked""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = _linked(spark, sf_dir)
    n = links.agg(F.count("*").alias("n_before"), F.count_if(F.col("root") == F.col("ord")).alias("n_after"))
    return n.select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), stats.duplicate_rate(F.col("n_before"), F.col("n_after")).alias("duplicate_rate"))


#: Names looked for in the test texts, where those of the published search don't occur.
NAMES = ["scGPT", "GPT", "LM", "Former", "Net", "Atlas", "cohort", "Bench"]
_NAMES = "(values " + ", ".join(f"('{x}')" for x in NAMES) + ") as v(name)"
_TEXT = "coalesce(title_original, '') || ' ' || coalesce(abstract, '')"


@query(f"select name, source_db, count(*) filter (contains(lower({_TEXT}), lower(name))) as n from unified_records, {_NAMES} group by 1, 2")
def name_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title_original", F.lit("")), F.coalesce("abstract", F.lit("")))
    return stats.name_matrix(table(spark, sf_dir, "unified_records"), NAMES, text, "source_db")


@query(f"select name, count(*) filter (contains(lower({_TEXT}), lower(name))) as n_found, count(*) filter (contains(lower({_TEXT}), lower(name))) > 0 as found from unified_records, {_NAMES} group by 1")
def name_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("title_original", F.lit("")), F.coalesce("abstract", F.lit("")))
    return stats.name_recall(table(spark, sf_dir, "unified_records"), NAMES, text)


@query("""select 'phase1' as stage, lower(trim(coalesce(phase1_decision, ''))) as decision, coalesce(phase1_code, '') as code, count(*) as n from screening_log group by 1, 2, 3
union all select 'phase2', lower(trim(coalesce(phase2_decision, ''))), coalesce(phase2_code, ''), count(*) from screening_log group by 1, 2, 3""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "screening_log")
    stages = F.array(*[F.struct(F.lit(p).alias("stage"), F.lower(F.trim(F.coalesce(f"{p}_decision", F.lit("")))).alias("decision"), F.coalesce(f"{p}_code", F.lit("")).alias("code")) for p in ("phase1", "phase2")])
    return log.select(F.inline(stages)).groupBy("stage", "decision", "code").agg(F.count("*").alias("n"))


# ---- picks and filters -------------------------------------------------------------------------------------------------------


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null) where k = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return filters.first_wins(events, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""select user_id, event_id, event_type, value, first_event_id from (select *, row_number() over (partition by user_id order by event_id desc) as k,
 min(event_id) over (partition by user_id) as first_event_id from events where user_id is not null) where k = 1""")
def last_wins_first_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return filters.last_wins_first_place(events, "user_id", ["event_id"], "first_event_id")


@query("""select distinct doi_normalized as doi from unified_records where source_db = 'springernature' and doi_normalized <> ''
 and doi_normalized not in (select doi_normalized from unified_records where source_db = 'scopus' and doi_normalized is not null)""")
def unseen_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("source_db", F.col("doi_normalized").alias("doi"))
    own = records.filter("source_db = 'springernature' AND doi <> ''")
    return filters.unseen(own, records.filter("source_db = 'scopus'"), "doi").select("doi").distinct()


@query("""select record_id, date from unified_records where case when coalesce(date, '') = '' then true
 when length(date) = 4 then coalesce(try_cast(date as int) <= 2023, true) when length(date) = 7 then date <= '2023-06' else left(date, 10) <= '2023-06-30' end""")
def date_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("record_id", "date")
    return records.filter(filters.within_cutoff(F.col("date"), "2023-06-30"))


@query("""select record_id, date from unified_records where case when coalesce(date, '') = '' then true else left(replace(date, '-', ''), 8) between '20200101' and '20231231' end""")
def date_range_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("record_id", "date")
    return records.filter(filters.in_compact_range(F.col("date"), "20200101", "20231231"))


# The three concept blocks of the published validation.
BLOCKS = [
    "single.cell|scRNA|RNA.?seq|gene expression|scATAC|ATAC.?seq|chromatin accessibility|CITE.?seq|spatial transcriptomics|multi.?omics|multiomics|transcriptomics|genomics|proteomics|epigenomics|cell type|gene regulatory",
    "language model|LLM|large language model|natural language|GPT|CLIP|cross-modal|multimodal|multi-modal|tokeniz|gene token|prompt|text generation|NLP",
    "foundation model|pretrain|pre-train|self-supervised|transformer|generative|decoder|autoregressive|transfer learning|zero-shot|few-shot|masked modeling|attention mechanism|deep learning",
]


@query("select cluster_id from deduplicated_records where " + " and ".join(f"regexp_matches(coalesce(title, '') || ' ' || coalesce(abstract, ''), '{b}', 'i')" for b in BLOCKS))
def block_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "title", "abstract")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return records.filter(filters.all_blocks(text, BLOCKS)).select("cluster_id")


@query(rf"""select cluster_id, coalesce(length({_strip("abstract")}) > 10, false) as has_abstract,
 case when coalesce(length({_strip("abstract")}) > 10, false) then '' else 'EC_NO_ABSTRACT' end as exclusion_code from deduplicated_records""")
def abstract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, excluded = enrichment.split_by_abstract(table(spark, sf_dir, "deduplicated_records").select("cluster_id", "abstract"))
    kept = kept.select("cluster_id", F.lit(True).alias("has_abstract"), F.lit("").alias("exclusion_code"))
    return kept.unionByName(excluded.select("cluster_id", F.lit(False).alias("has_abstract"), "exclusion_code"))


# ---- Boolean search: one query per dialect ------------------------------------------------------------------------------------


def _has(text: str, *fields: str) -> str:
    """SQL: a term in any of the fields by the local meaning."""
    open_end = text.endswith("*")
    words = r"[\s-]+".join(text.rstrip("*").replace("-", " ").split())
    end = "" if open_end else r"([^\p{L}\p{N}]|$)"
    return "(" + " or ".join(rf"coalesce(regexp_matches({f}, '(^|[^\p{{L}}\p{{N}}]){words}{end}', 'i'), false)" for f in fields) + ")"


_TA = ("title", "abstract")


def _searched(spark: SparkSession, sf_dir: str, text: str, dialect: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records")
    columns = {"title": F.col("title"), "abstract": F.col("abstract"), "keywords": F.col("venue"), "year": F.col("year"), "date": F.col("date"), "source": F.array_join("sources", "|")}
    return records.filter(search(text, dialect, columns)).select("cluster_id")


@query(f"""select cluster_id from deduplicated_records where ({_has("language model", *_TA)} or {_has("prompt", "title")}) and {_has("cell type", *_TA)}
 and coalesce(date >= '2019-01-01' and left(date, 10) <= '2023-12-31', false)""")
def bool_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '("language model"[Title/Abstract] OR prompt[Title]) AND "cell type"[Title/Abstract] AND ("2019/01/01"[Date - Publication] : "2023/12/31"[Date - Publication])'
    return _searched(spark, sf_dir, text, "pubmed")


_K = ("title", "abstract", "venue")


@query(f"""select cluster_id from deduplicated_records where ({_has("tokeniz*", *_K)} or {_has("gene vocabulary", *_K)}) and {_has("single-nucleus", *_K)}
 and coalesce(year >= '2021' and left(year, 4) <= '9999', false)""")
def bool_scopus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, 'TITLE-ABS-KEY((tokeniz* OR "gene vocabulary") AND "single-nucleus") AND PUBYEAR > 2020 AND OPENACCESS(1)', "scopus")


@query(f"""select cluster_id from deduplicated_records where ({_has("zero-shot", *_TA)} or {_has("few-shot", *_TA)}) and {_has("donor*", *_TA)} and not {_has("benchmarking", *_TA)}""")
def bool_semantic_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '("zero-shot" | "few-shot") + donor* -benchmarking', "semantic_scholar")


@query(f"""select cluster_id from deduplicated_records where {_has("foundation model", "title")} and {_has("language model", "abstract")} or {_has("generative", "title")} and not {_has("retina", "title")}""")
def bool_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, 'ti:"foundation model" AND abs:"language model" OR (ti:generative ANDNOT ti:retina)', "arxiv")


@query(f"""select cluster_id from deduplicated_records where {_has("gene regulatory", *_TA)} and {_has("pretrain*", *_TA)} and coalesce(date >= '2020-01-01' and left(date, 10) <= '2025-12-31', false)""")
def bool_europepmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '"gene regulatory" AND pretrain* AND FIRST_PDATE:[2020-01-01 TO 2025-12-31]', "europepmc")


@query(f"""select cluster_id from deduplicated_records where ({_has("spatial transcriptomics", *_TA)} or {_has("CITE-seq", *_TA)}) and {_has("autoregressive", *_TA)}
 and coalesce(date >= '2018-01-01' and left(date, 4) <= '9999', false) and coalesce(date >= '0000' and left(date, 10) <= '2024-12-31', false)""")
def bool_springernature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '("spatial transcriptomics" OR "CITE-seq") AND autoregressive AND datefrom:2018-01-01 dateto:2024-12-31', "springernature")


@query(f"""select cluster_id from deduplicated_records where {_has("foundation model", *_TA)} and {_has("generative", *_TA)} and {_has("chromatin", *_TA)}""")
def bool_google_scholar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, '"foundation model" generative chromatin', "google_scholar")


def _published_sql(dialect: str, name: str) -> str:
    """SQL of a published text by replacing its parts one by one, apart from the parser."""
    between = lambda c, low, high: f"coalesce({c} >= '{low}' and left({c}, {len(high)}) <= '{high}', false)"
    kept: list[str] = []

    def keep(sql: str) -> str:
        kept.append(sql)
        return f" @{len(kept) - 1}@ "

    def term(m: re.Match) -> str:
        word = m[2].strip('"')
        if word in ("AND", "OR"):
            return m[0]
        fields = {"ti:": ("title",), "abs:": ("abstract",)}.get(m[1], _K if dialect == "scopus" else _TA)
        return keep(_has(word, *fields))

    text = PUBLISHED[dialect][name]
    text = re.sub(r'"free full text"\[sb\]|English\[Language\]|(?:OPENACCESS|LANGUAGE)\(\w+\)|SRC:PPR|cat:[\w.-]+', lambda _: keep("true"), text)
    text = re.sub(r'\("2018/01/01"\[Date - Publication\] : "2026/02/28"\[Date - Publication\]\)|(?:submittedDate|FIRST_PDATE):\[[^]]*\]', lambda _: keep(between("date", "2018-01-01", "2026-02-28")), text)
    text = re.sub(r"datefrom:\S+ dateto:\S+", lambda _: keep(f"{between('date', '2018-01-01', '9999')} and {between('date', '0000', '2026-02-28')}"), text)
    text = text.replace("PUBYEAR > 2017", keep(between("year", "2018", "9999"))).replace("TITLE-ABS-KEY", "")
    text = text.replace(" | ", " OR ").replace(" + ", " AND ")
    text = re.sub(r'(?<!@)(ti:|abs:)?("[^"]*"|(?<![\w@-])[A-Za-z][\w*-]*)(\[Title/Abstract\])?', term, text)
    text = re.sub(r"@\s+@", "@ AND @", text)
    return re.sub(r"@(\d+)@", lambda m: f"({kept[int(m[1])]})", text)


@query(" union all ".join(f"select '{d}' as dialect, '{n}' as name, cluster_id from deduplicated_records where {_published_sql(d, n)}" for d in PUBLISHED for n in PUBLISHED[d]))
def bool_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    # language, access, category and source have no column here: the provider is taken to have applied them
    columns = {"title": F.col("title"), "abstract": F.col("abstract"), "keywords": F.col("venue"), "year": F.col("year"), "date": F.col("date")}
    hits = [F.when(search(text, d, columns), F.struct(F.lit(d).alias("dialect"), F.lit(n).alias("name"))) for d, texts in PUBLISHED.items() for n, text in texts.items()]
    found = table(spark, sf_dir, "deduplicated_records").select("cluster_id", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.select("h.dialect", "h.name", "cluster_id")


# ---- enrichment and titles ---------------------------------------------------------------------------------------------------

_D = f"{_strip("lower(regexp_replace(" + _strip("coalesce(doi, '')") + ", '^https?://(dx.)?doi.org/', '', 'i'))")}"
_LONG = f"length({_strip('abstract')}) > 10"


@query(rf"""with g as (select cluster_id, coalesce(abstract, '') as abstract, {_D} as doi_key, coalesce(pmid, '') as pmid_key, lower({_strip("coalesce(title, '')")}) as title_key from deduplicated_records),
s2 as (select doi_normalized as k, min({_strip("abstract")}) as v from unified_records where source_db = 'semantic_scholar' and doi_normalized <> '' and {_LONG} group by 1),
cr as (select doi_normalized as k, min({_strip("regexp_replace(abstract, '<[^>]+>', '', 'g')")}) as v from unified_records where source_db in ('springernature', 'scopus') and doi_normalized <> '' and {_LONG} group by 1),
pm as (select pmid as k, min({_strip("abstract")}) as v from unified_records where source_db = 'pubmed' and pmid <> '' and {_LONG} group by 1),
ti as (select lower({_strip("coalesce(title_original, '')")}) as k, min({_strip("abstract")}) as v from unified_records where source_db = 'semantic_scholar' and {_LONG} group by 1),
j as (select g.*, coalesce(length({_strip("g.abstract")}) > 10, false) as there, nullif(s2.v, '') as s2, nullif(cr.v, '') as cr, nullif(pm.v, '') as pm, nullif(ti.v, '') as ti from g
 left join s2 on s2.k = doi_key left join cr on cr.k = doi_key left join pm on pm.k = pmid_key left join ti on ti.k = title_key and title_key <> '' and doi_key = '' and pmid_key = '')
select cluster_id, case when there then abstract else coalesce(s2, cr, pm, ti, abstract) end as abstract,
 case when there then null when s2 is not null then 's2_doi' when cr is not null then 'crossref' when pm is not null then 'pubmed' when ti is not null then 's2_title' end as abstract_source from j""")
def enrich_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden, source = table(spark, sf_dir, "deduplicated_records"), table(spark, sf_dir, "unified_records")
    title = F.lower(enrichment.py_strip(F.coalesce("title", F.lit(""))))
    doi, pmid = normalize_doi(F.col("doi")), F.coalesce("pmid", F.lit(""))
    records = golden.select("cluster_id", F.coalesce("abstract", F.lit("")).alias("abstract"), doi.alias("doi_key"), pmid.alias("pmid_key"), title.alias("title_key"))
    # titles are asked only for records without any identifier
    records = records.withColumn("title_key", F.when((F.col("doi_key") == "") & (F.col("pmid_key") == ""), F.col("title_key")).otherwise(""))
    source = source.select("source_db", "abstract", F.col("doi_normalized").alias("doi_key"), F.col("pmid").alias("pmid_key"), F.lower(enrichment.py_strip(F.coalesce("title_original", F.lit("")))).alias("title_key"))
    scholar = source.filter("source_db = 'semantic_scholar'")
    stages = [
        ("s2_doi", enrichment.by_doi(scholar), "doi_key"),
        ("crossref", enrichment.by_doi(source.filter("source_db IN ('springernature', 'scopus')"), tags=True), "doi_key"),
        ("pubmed", enrichment.by_doi(source.filter("source_db = 'pubmed'"), "pmid_key"), "pmid_key"),
        ("s2_title", enrichment.by_doi(scholar, "title_key"), "title_key"),
        # beyond the SQL, which ends at equal titles
        ("s2_title", lambda missing: enrichment.by_similar_title(missing, scholar, "title_key"), "title_key"),
    ]
    return enrichment.waterfall(records, stages).select("cluster_id", "abstract", "abstract_source")


_WORDS = rf"list_distinct(list_filter(regexp_split_to_array(lower(title), '[{WS}]+'), lambda w: w <> ''))"


@query(f"""with w as (select cluster_id, {_WORDS} as w from deduplicated_records where title is not null), q as (select * from w where cluster_id % 100 = 0)
select q.cluster_id as query_id, w.cluster_id, len(list_intersect(q.w, w.w)) / greatest(len(q.w), len(w.w)) as similarity from q join w on q.cluster_id <> w.cluster_id
where len(q.w) > 0 and len(w.w) > 0 and len(list_intersect(q.w, w.w)) / greatest(len(q.w), len(w.w)) > 0.8""")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "deduplicated_records").select("cluster_id", "title")
    return similar_titles(records.filter("cluster_id % 100 = 0"), records, "cluster_id", "title")


@query("select source_api, count(*) as n, sum(abstract_len)::bigint as n_chars from enrichment_details group by 1")
def enrichment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "enrichment_details").groupBy("source_api").agg(F.count("*").alias("n"), F.sum("abstract_len").cast("long").alias("n_chars"))


# ---- streams as bounded tables -----------------------------------------------------------------------------------------------


@query("select date_trunc('day', fetched_at) as window_start, source_db, count(*) as n from unified_records where fetched_at is not null group by 1, 2")
def arrivals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counts_by_window(table(spark, sf_dir, "unified_records"), "fetched_at", "source_db")
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select distinct record_id, source_db, title_original from unified_records where record_id is not null")
def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("record_id", "fetched_at", "source_db", "title_original")
    return first_arrivals(records, "record_id", "fetched_at").select("record_id", "source_db", "title_original")


@query(rf"""with l as (select doc_id, unnest(list_transform(string_split({_strip("text")}, chr(10)), lambda x: {_strip("x")})) as line, unnest(range(len(string_split({_strip("text")}, chr(10))))) as i from documents where text is not null),
a as (select doc_id, min(i) as a from l where line = '' and i > 2 group by 1), b as (select l.doc_id, min(i) as b from l join a using (doc_id) where i > a and line <> '' group by 1),
c as (select b.doc_id, b, coalesce(min(i) filter (line = '' and i > b), 1000000000) as c from l join b using (doc_id) group by 1, 2)
select l.doc_id, string_agg(line, ' ' order by i) as abstract from l join c on l.doc_id = c.doc_id and i >= b and i < c group by 1 having length(string_agg(line, ' ' order by i)) > 10""")
def text_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", pubmed_text_abstract(F.col("text")).alias("abstract"))
    return docs.filter("abstract is not null")


@query("select source_db, record_id, year from (select *, row_number() over (partition by source_db order by year desc, record_id, fetched_at) as k from (select distinct source_db, record_id, year, fetched_at from unified_records)) where k <= 3")
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "unified_records").select("source_db", "record_id", "year", "fetched_at").distinct()
    return filters.first_k(records, "source_db", [F.desc("year"), "record_id", "fetched_at"], 3).drop("fetched_at")


@query("select cluster_id, left(title, 100) as title from deduplicated_records where not coalesce(length(" + _strip("abstract") + ") > 10, false) order by cluster_id limit 25")
def first_missing_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = filters.first_missing(table(spark, sf_dir, "deduplicated_records"), "abstract", "cluster_id", 25)
    return missing.select("cluster_id", F.left("title", F.lit(100)).alias("title"))
