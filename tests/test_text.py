import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from biblioflux.functions import text
from biblioflux.functions.identifiers import canonical_arxiv, canonical_doi, canonical_pmid, is_preprint_doi


def column(rows, values, make):
    df = rows([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_titles_follow_the_scripting_rules(rows):
    titles = ["Café <i>au</i> lait", "a_b-c", "  x y z ", "p<0.05 and q>1", "ΑΒΓ ²", "", None, "İstanbul", "naïve\tT\ncells", "日本語、題名", "a" * 50_000]

    def expected(s):
        s = re.sub(r"<[^>]+>", "", unicodedata.normalize("NFC", s or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s)).strip()

    got = column(rows, titles, text.normalize_title)
    skip = {titles.index("İstanbul")}  # a combining dot is a word character for one engine only
    assert [g for k, g in enumerate(got) if k not in skip] == [expected(s) for k, s in enumerate(titles) if k not in skip]


def test_strip_knows_every_white_space(rows):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert column(rows, [spaces + "a b" + spaces, spaces, "", None], text.py_strip) == ["a b", "", "", None]


def test_dois_and_arxiv_ids_of_the_linkage(rows):
    assert column(rows, [" HTTPS://DX.DOI.ORG/10.1/A ", "doi:10.1/B", "http://doi.org/http://doi.org/10.1/c", None], text.normalize_doi) == ["10.1/a", "doi:10.1/b", "http://doi.org/10.1/c", ""]
    assert column(rows, ["2101.00001v2", "2101.00001V2", "cs/0101001v1 ", None], text.normalize_arxiv_id) == ["2101.00001", "2101.00001v2", "cs/0101001", ""]


def test_word_overlap(rows):
    df = rows([("a b c", "c b a"), ("a a b", "a c"), ("", ""), ("x", None)], "a string, b string")
    got = [r[0] for r in df.select(text.word_overlap(F.col("a"), F.coalesce("b", F.lit("")))).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (canonical_doi, {"DOI: 10.1101/X22.ABC": "10.1101/x22.abc", "https://doi.example/10.99001/a%2Fb.": "10.99001/a/b", "10.1101%2Fx21": "10.1101/x21", "10.99067 / FS/7": "10.99067/fs/7", "<10.99012/9r.11>": "10.99012/9r.11", "https://p.example/doi/10.99007/n/s?via=x": "10.99007/n/s", "10.99053/k/v#sec2": "10.99053/k/v", "doi :10.99038/s-037z;": "10.99038/s-037z", "n/a": None, "10.99/100%": None, "10.9999/100%": "10.9999/100%", "": None, None: None}),
        (canonical_pmid, {"PMID: 00123": "123", "917088128.0": "917088128", "pmid:7 ": "7", "0": None, "N/A": None, None: None, "12a": None}),
        (canonical_arxiv, {"arXiv:2444.19992": "2444.19992", " 2531.49541V1 ": "2531.49541", "https://p.example/abs/1925.91705v1": "1925.91705", "https://p.example/pdf/2331.68469.pdf": "2331.68469", "ARXIV: cs/0101001": "cs/0101001", "-": None, None: None}),
    ],
)
def test_canonical_identifiers(rows, make, cases):
    assert dict(zip(cases, column(rows, list(cases), make), strict=True)) == cases


def test_preprints(rows):
    assert column(rows, ["10.1101/x", "10.48550/arxiv.x", "10.21203/rs.1", None], is_preprint_doi) == [True, True, False, False]


def test_plain_text_citation(rows):
    cite = "1. J. 2020.\n\nTitle\n\nAuthors A.\n\nThe abstract\n  goes on.\n\nPMID: 1"
    late = "a\nb\nc\n\n\n\r\nOnly this paragraph\ncounts here\n\nnot this"
    assert column(rows, [cite, late, "short", "", None, "a\nb\nc\n\nten chars."], text.pubmed_text_abstract) == [None, "Only this paragraph counts here", None, None, None, None]


def test_quoting(rows):
    assert column(rows, ["10.1/a b*~é"], text.url_quote) == ["10.1%2Fa%20b%2A~%C3%A9"]
