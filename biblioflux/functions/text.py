"""Text normalization as Column expressions with the whitespace and word classes of Unicode-aware scripting languages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as white space.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


#: The same characters, one by one.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def py_strip(c: Column) -> Column:
    """Strip all Unicode white space (the built-in trim strips U+0020 only)."""
    return F.btrim(c, F.lit(WS_CHARS))


def first_non_empty(*cols: Column) -> Column:
    """The first argument that is neither null nor ''; '' if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """NFC; only texts with non-ASCII characters take the trip through Arrow."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfc(c)).otherwise(c)


def normalize_doi(c: Column) -> Column:
    """Strip, drop one leading doi.org address, lower-case; '' for null."""
    s = F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return py_strip(F.lower(s))


def normalize_arxiv_id(c: Column) -> Column:
    """Strip, drop a closing lower-case version, lower-case; '' for null."""
    return F.lower(F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), r"v\d+$", ""))


def normalize_title(c: Column) -> Column:
    """NFC, lower-case, without tags and punctuation (underscores stay), white space collapsed; '' for null."""
    s = F.lower(nfc(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(strip_tags(s), rf"[^\p{{L}}\p{{N}}_{WS}]", "")
    return py_strip(F.regexp_replace(s, f"[{WS}]+", " "))


def words_of(c: Column) -> Column:
    """Distinct white-space separated words, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(c), f"[{WS}]+"), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """|A∩B| / max(|A|, |B|) over distinct words; 0 where both are empty."""
    wa, wb = words_of(a), words_of(b)
    most = F.greatest(F.size(wa), F.size(wb))
    return F.when(most > 0, F.size(F.array_intersect(wa, wb)) / most).otherwise(F.lit(0.0))


def pubmed_text_abstract(c: Column, least: int = 10) -> Column:
    """The abstract in a plain-text citation: the first paragraph after the first blank line behind the third line, its lines joined by
    blanks; null if it isn't longer than ``least``. Carriage returns count as white space."""
    lines = F.transform(F.split(py_strip(c), "\n"), lambda x, i: F.struct(py_strip(x).alias("text"), i.alias("at")))
    nothing = F.array().cast("array<string>")

    def state(on: Column, off: Column, out: Column) -> Column:
        return F.struct(on.alias("on"), off.alias("off"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        blank = x["text"] == ""
        return (
            F.when(s["off"] | (~s["on"] & ~(blank & (x["at"] > 2))), s)
            .when(~s["on"], state(F.lit(True), F.lit(False), s["out"]))
            .when(blank, state(F.lit(True), F.size(s["out"]) > 0, s["out"]))
            .otherwise(state(F.lit(True), F.lit(False), F.concat(s["out"], F.array(x["text"]))))
        )

    text = F.aggregate(lines, state(F.lit(False), F.lit(False), nothing), step, lambda s: F.array_join(s["out"], " "))
    return F.when(F.length(text) > least, text)


def url_quote(c: Column) -> Column:
    """Percent-encoding with nothing left out but letters, digits and '-_.~' (the built-in writes a blank as '+' and keeps '*')."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
