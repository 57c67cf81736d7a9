"""Identifier canonicalization as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblioflux.functions.text import py_strip

# Spellings of "missing" seen in bibliographic exports.
PLACEHOLDERS = ["", "-", "--", "0", "n/a", "na", "nan", "nil", "none", "null", "unknown", "not available", "undefined", "missing", "tbd", "?"]
# DOI prefixes of preprint servers.
PREPRINT_PREFIXES = ["10.1101/", "10.48550/arxiv"]


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(py_strip(c)).isin(PLACEHOLDERS), F.lit(True))


def canonical_doi(c: Column) -> Column:
    """A DOI without label, address, percent-coding, query, fragment, white space, case and closing punctuation; null if there is none.

    Invalid percent-coding stays as written. Anything before the first ``10.<digits>/`` counts as label.
    """
    s = F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Cf}]+", "")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", "%2B")), s)
    s = F.regexp_replace(F.lower(decoded), r"[\s\p{Z}\p{Cf}]+", "")
    body = F.regexp_extract(s, r"(10\.\d{4,9}(?:\.\d+)*/[^?#]+)", 1)
    body = F.regexp_replace(body, r"[.,;:!/)\]}>\"'”’]+$", "")
    return F.when(F.length(body) > 0, body)


def canonical_pmid(c: Column) -> Column:
    """The digits of a PMID without label, white space, leading zeros and decimal part; null for placeholders and zero."""
    s = F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Cf}]+", "")
    digits = F.regexp_extract(s, r"^(?:https?://[^0-9]*/)?(?:pubmed|pmid)?(?:id)?[:#/]*0*([1-9]\d*)(?:\.0*)?/?$", 1)
    return F.when(F.length(digits) > 0, digits)


def canonical_arxiv(c: Column) -> Column:
    """An arXiv id without label, address, file ending, version and case; null for placeholders."""
    s = F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Cf}]+", "")
    body = F.regexp_extract(s, r"(?:^|[:/])(\d{4}\.\d{4,6}|[a-z][a-z.\-]*/\d{7})(?:v\d+)?(?:\.pdf)?/?(?:[?#].*)?$", 1)
    return F.when(F.length(body) > 0, body)


def is_preprint_doi(c: Column) -> Column:
    """True where a canonical DOI belongs to a preprint server; false for null."""
    hit = F.lit(False)
    for p in PREPRINT_PREFIXES:
        hit = hit | F.startswith(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))
