"""Provider payloads (JSON items, PubMed XML, Atom entries) as source records, by Column expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PUBMED = """MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>,
 AuthorList:struct<Author:array<struct<LastName:string, ForeName:string>>>, Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string, Month:string>>>>>,
 PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string, _IdType:string>>>>"""
_ATOM = """id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>,
 link array<struct<_title:string, _href:string>>"""


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _item(df: DataFrame, column: str, ddl: str) -> DataFrame:
    return df.select(F.from_json(column, ddl).alias("i")).filter("i is not null")


def pubmed(df: DataFrame, column: str) -> DataFrame:
    """One row per PubmedArticle text that has a PMID and an Article; authors without a last name are left out."""
    # attributes of elements that are read as plain text are ignored by the parser
    parsed = df.select(F.from_xml(column, _PUBMED, {"ignoreNamespace": "true"}).alias("x")).select("x.*")
    art = F.col("MedlineCitation.Article")
    names = F.transform(F.filter(art["AuthorList"]["Author"], lambda a: F.coalesce(a["LastName"], F.lit("")) != ""), lambda a: F.trim(F.concat_ws(" ", a["LastName"], a["ForeName"])))
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    date = art["Journal"]["JournalIssue"]["PubDate"]
    return parsed.filter(F.col("MedlineCitation.PMID").isNotNull() & art.isNotNull()).select(
        F.col("MedlineCitation.PMID").alias("pmid"), _or_empty(F.get(ids["_VALUE"], F.lit(0))).alias("doi"), _or_empty(art["ArticleTitle"]).alias("title"),
        _or_empty(F.array_join(art["Abstract"]["AbstractText"], " ")).alias("abstract"), _or_empty(F.array_join(names, "; ")).alias("authors"),
        _or_empty(date["Year"]).alias("year"), _or_empty(date["Month"]).alias("month"), _or_empty(art["Journal"]["Title"]).alias("journal"), F.lit("pubmed").alias("source"),
    )


def scopus(df: DataFrame, column: str) -> DataFrame:
    keys = ["dc:identifier", "prism:doi", "dc:title", "dc:creator", "prism:publicationName", "prism:coverDate", "citedby-count"]
    i = _item(df, column, ", ".join(f"`{k}` string" for k in keys))
    at = {k: F.col(f"i.`{k}`") for k in keys}
    return i.select(
        F.replace(_or_empty(at["dc:identifier"]), F.lit("SCOPUS_ID:"), F.lit("")).alias("scopus_id"), _or_empty(at["prism:doi"]).alias("doi"),
        _or_empty(at["dc:title"]).alias("title"), _or_empty(at["dc:creator"]).alias("authors"), _or_empty(at["prism:publicationName"]).alias("journal"),
        F.left(_or_empty(at["prism:coverDate"]), F.lit(4)).alias("year"), _or_empty(at["prism:coverDate"]).alias("date"),
        F.coalesce(at["citedby-count"], F.lit("0")).alias("cited_by"), F.lit("scopus").alias("source"),
    )


def semantic_scholar(df: DataFrame, column: str) -> DataFrame:
    ddl = """paperId string, externalIds struct<DOI:string, ArXiv:string, PubMed:string>, title string, abstract string, year int, venue string, citationCount int,
     fieldsOfStudy array<string>, publicationTypes array<string>, openAccessPdf struct<url:string>, publicationDate string, authors array<struct<name:string>>"""
    none = F.array().cast("array<string>")
    return _item(df, column, ddl).select(
        _or_empty("i.paperId").alias("s2_id"), _or_empty("i.externalIds.DOI").alias("doi"), _or_empty("i.externalIds.ArXiv").alias("arxiv_id"),
        _or_empty("i.externalIds.PubMed").alias("pmid"), _or_empty("i.title").alias("title"), _or_empty("i.abstract").alias("abstract"), F.col("i.year").alias("year"),
        _or_empty("i.venue").alias("venue"), F.coalesce("i.citationCount", F.lit(0)).alias("citation_count"), F.coalesce("i.fieldsOfStudy", none).alias("fields_of_study"),
        F.coalesce("i.publicationTypes", none).alias("publication_types"), _or_empty("i.openAccessPdf.url").alias("open_access_pdf"), _or_empty("i.publicationDate").alias("date"),
        _or_empty(F.array_join("i.authors.name", "; ", "")).alias("authors"), F.lit("semantic_scholar").alias("source"),
    )


def arxiv(df: DataFrame, column: str, found_by: str = "primary") -> DataFrame:
    """One row per Atom entry with an id; the last link titled doi counts."""
    x = df.select(F.from_xml(column, _ATOM, {"ignoreNamespace": "true"}).alias("x")).select("x.*").filter("id <> ''")
    line = lambda c: F.trim(F.replace(_or_empty(c), F.lit("\n"), F.lit(" ")))
    links = F.filter("link", lambda k: k["_title"] == "doi")
    day = F.left(_or_empty("published"), F.lit(10))
    names = F.filter("author.name", lambda n: F.coalesce(n, F.lit("")) != "")
    return x.select(
        F.when(F.contains("id", F.lit("/abs/")), F.element_at(F.split("id", "/abs/"), -1)).otherwise(F.col("id")).alias("arxiv_id"),
        _or_empty(F.try_element_at(links["_href"], F.lit(-1))).alias("doi"), line("title").alias("title"), line("summary").alias("abstract"),
        _or_empty(F.array_join(names, "; ")).alias("authors"), day.alias("date"), F.left(day, F.lit(4)).alias("year"),
        F.filter("category._term", lambda t: F.coalesce(t, F.lit("")) != "").alias("categories"), F.lit("arxiv").alias("source"), F.lit(found_by).alias("found_by_query"),
    )


def europepmc(df: DataFrame, column: str) -> DataFrame:
    keys = {"id": "epmc_id", "doi": "doi", "pmid": "pmid", "title": "title", "abstractText": "abstract", "authorString": "authors", "journalTitle": "journal", "firstPublicationDate": "date", "pubYear": "year", "source": "source_db"}
    i = _item(df, column, ", ".join(f"{k} string" for k in keys))
    return i.select(*[_or_empty(f"i.{k}").alias(v) for k, v in keys.items()], F.lit("europepmc_preprints").alias("source"))


def springernature(df: DataFrame, column: str) -> DataFrame:
    """The DOI falls back on an identifier that starts with doi:; an abstract that is an object keeps its JSON text."""
    ddl = "title string, doi string, identifier string, url string, creators string, publicationDate string, publicationName string, contentType string, abstract string, openaccess string"
    i = _item(df, column, ddl)
    spare = F.when(F.startswith(_or_empty("i.identifier"), F.lit("doi:")), F.substring("i.identifier", 5, 1_000_000))
    urls = F.from_json("i.url", "array<struct<value:string>>")
    names = F.from_json("i.creators", "array<struct<creator:string>>")["creator"]
    return i.select(
        F.lit("springernature").alias("source"), _or_empty("i.title").alias("title"), F.coalesce(F.nullif(F.col("i.doi"), F.lit("")), spare, F.lit("")).alias("doi"),
        _or_empty(F.get(urls["value"], F.lit(0))).alias("url"), F.transform(F.coalesce(names, F.array().cast("array<string>")), _or_empty).alias("authors"),
        *[_or_empty(f"i.{c}").alias(c) for c in ("publicationDate", "publicationName", "contentType", "abstract", "openaccess")],
    )


def google_scholar(df: DataFrame, column: str, query_id: str = "") -> DataFrame:
    """The address falls back on the eprint's where the publication has none; a single author's name is a list of one."""
    ddl = "bib struct<title:string, author:string, pub_year:string, abstract:string, venue:string>, pub_url string, eprint_url string, num_citations int, citedby_url string"
    i = _item(df, column, ddl)
    names = F.from_json("i.bib.author", "array<string>")
    one = F.when(_or_empty("i.bib.author") != "", F.array("i.bib.author"))
    return i.select(
        F.lit("google_scholar").alias("source"), F.lit(query_id).alias("query_id"), _or_empty("i.bib.title").alias("title"),
        F.coalesce(F.when(F.startswith("i.bib.author", F.lit("[")), F.transform(names, _or_empty)), one, F.array().cast("array<string>")).alias("authors"), _or_empty("i.bib.pub_year").alias("year"),
        *[_or_empty(f"i.bib.{c}").alias(c) for c in ("abstract", "venue")], F.coalesce("i.pub_url", "i.eprint_url", F.lit("")).alias("url"),
        F.coalesce("i.num_citations", F.lit(0)).alias("num_citations"), _or_empty("i.citedby_url").alias("citedby_url"),
    )
