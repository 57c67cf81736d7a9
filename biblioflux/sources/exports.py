"""Database exports (JSON objects with ``records`` or bare arrays) as unified records, and their discovery by date."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflux.functions.text import first_non_empty, normalize_arxiv_id, normalize_doi, normalize_title, py_strip
from biblioflux.schema import DB_ORDER, UNIFIED


def latest_date(folder: str) -> str | None:
    """The date of the lexically last pubmed export; None without one."""
    dates = sorted(m[1] for f in os.listdir(folder) if (m := re.fullmatch(r"pubmed_(.+)\.json", f)))
    return dates[-1] if dates else None


def export_files(folder: str, date: str, filtered_springernature: bool = True) -> dict[str, str]:
    """database -> path of its export of that date; missing ones are left out. ``filtered_springernature`` prefers the validated
    export over one of the plain name, which older runs used for the raw list."""
    out = {}
    for db in DB_ORDER:
        names = [f"{db}_{date}.json"]
        if db == "springernature":
            names.append(f"springernature_filtered_{date}.json")
            if filtered_springernature:
                names.reverse()
        found = [p for n in names if os.path.exists(p := os.path.join(folder, n))]
        if found:
            out[db] = found[0]
    return out


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(pos, rec): the records of one export as variants in file order; an object without records or another shape gives none."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    array = F.expr("CASE WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN v ELSE try_variant_get(v, '$.records', 'variant') END")
    listed = whole.select(array.alias("a")).filter("schema_of_variant(a) LIKE 'ARRAY%'")
    return spark.sql("SELECT pos, value AS rec FROM {listed}, LATERAL variant_explode(a)", listed=listed)


def _text(name: str) -> Column:
    """A field of the record as text; null for null, a missing field, an object or an array."""
    path = f"try_variant_get(rec, '$.{name}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({path}) NOT RLIKE '^(OBJECT|ARRAY)' THEN try_variant_get(rec, '$.{name}', 'string') END")


def _list(name: str) -> Column:
    """A list of texts joined by '; '; a plain text stays as it is."""
    return F.coalesce(F.expr(f"array_join(try_variant_get(rec, '$.{name}', 'array<string>'), '; ')"), _text(name), F.lit(""))


def unify(export: DataFrame, db: str) -> DataFrame:
    """Unified records of one export, in the columns of UNIFIED and ``pos``; missing values are ''. Whatever fields a record has,
    the same mapping applies, and the database's own id exists for its database only."""

    def field(*names: str) -> Column:
        return py_strip(first_non_empty(*[_text(n) for n in names]))

    own = {"scopus_id": "scopus", "epmc_id": "biorxiv_medrxiv"}
    columns = {
        "source_db": F.lit(db),
        "title_original": field("title"), "title_normalized": normalize_title(_text("title")),
        "doi_original": field("doi"), "doi_normalized": normalize_doi(_text("doi")), "pmid": field("pmid"),
        "arxiv_id_original": field("arxiv_id"), "arxiv_id_normalized": normalize_arxiv_id(_text("arxiv_id")), "s2_id": field("s2_id"),
        "abstract": F.when(F.expr("schema_of_variant(try_variant_get(rec, '$.abstract', 'variant')) = 'STRING'"), field("abstract")).otherwise(""),
        "authors": _list("authors"), "year": field("year"), "venue": field("venue", "journal", "publicationName"),
        "date": field("date", "publicationDate"), "url": field("url", "open_access_pdf"),
    } | {c: field(c) if db == owner else F.lit(None).cast("string") for c, owner in own.items()}
    return export.select("pos", *[columns[c].alias(c) for c in UNIFIED])


def load_exports(spark: SparkSession, folder: str, date: str | None = None) -> DataFrame:
    """Unified records of all exports of a date (by default the latest), in no particular order; (source_db, pos) gives the order."""
    date = date or latest_date(folder)
    files = export_files(folder, date) if date else {}
    if not files:
        raise FileNotFoundError(f"no exports in {folder}")
    return reduce(DataFrame.unionByName, [unify(read_export(spark, p), db) for db, p in files.items()])


def larger(live: DataFrame, cached: DataFrame) -> DataFrame:
    """The cached export where the live one has fewer records, else the live one; both are counted."""
    return cached if live.count() < cached.count() else live
