import pytest
from pyspark.sql import functions as F

from biblioflux.plans.boolean import DIALECTS, And, Facet, Not, Or, Range, Term, parse, search
from biblioflux.plans.published import PUBLISHED

ROWS = [
    (1, "A large language-model for cells", "single cell tokenizers", "2020-05-01"), (2, "GPT review", "gene expression", "2017"),
    (3, None, None, None), (4, "Foundation models", "tokenization of genes", "2024-01"), (5, "scGPT", "languages model", "2023-12-31"),
]


@pytest.mark.parametrize(
    ("dialect", "text", "want"),
    [
        ("pubmed", '"language model"[Title/Abstract] AND "single-cell"[Title/Abstract]', {1}),
        ("pubmed", 'GPT[Title] AND ("2016"[Date - Publication] : "2018"[Date - Publication])', {2}),
        ("scopus", "TITLE-ABS-KEY(tokeniz*) AND PUBYEAR > 2021 AND OPENACCESS(1)", {4}),
        ("semantic_scholar", '("gene expression" | tokeniz*) + -GPT', {1, 4}),
        ("arxiv", "abs:tokenization OR ti:GPT ANDNOT ti:review", {4}),
        ("europepmc", "tokeniz* AND FIRST_PDATE:[2020-01-01 TO 2020-12-31]", {1}),
        ("springernature", "(GPT OR scGPT) AND datefrom:2018-01-01 dateto:2024-12-31", {5}),
        ("google_scholar", '"foundation models" tokenization', {4}),
    ],
)
def test_dialects(rows, dialect, text, want):
    df = rows(ROWS, "id int, title string, abstract string, date string")
    columns = {"title": F.col("title"), "abstract": F.col("abstract"), "date": F.col("date"), "year": F.left("date", F.lit(4))}
    assert {r["id"] for r in df.filter(search(text, dialect, columns)).collect()} == want


def test_trees():
    assert parse("a OR b c", "google_scholar") == Or((Term("a"), And((Term("b"), Term("c")))))
    assert parse("NOT (a AND b)", "pubmed") == Not(And((Term("a"), Term("b"))))
    assert parse("cat:cs.LG AND cell-to-text", "arxiv") == And((Facet("category", "cs.LG"), Term("cell-to-text")))
    assert parse("submittedDate:[20180101 TO 20260228]", "arxiv") == Range("date", "2018-01-01", "2026-02-28")


@pytest.mark.parametrize("bad", ["(a OR b", "a)", "FOO(a)", "a AND"])
def test_errors(bad):
    with pytest.raises(ValueError):
        parse(bad, "scopus")


def test_unknown_dialect():
    with pytest.raises(ValueError):
        parse("a", "other")


def test_published_texts():
    trees = {(d, n): parse(text, d) for d, texts in PUBLISHED.items() for n, text in texts.items()}
    assert len(trees) == 17 and {d for d, _ in trees} == set(DIALECTS)
    blocks = lambda d, n="main": [len(x.items) for x in trees[d, n].items if isinstance(x, Or)]
    assert blocks("pubmed") == []  # the blocks stand in a bracket of their own
    assert [len(x.items) for x in trees["pubmed", "main"].items[0].items] == [20, 16, 14]
    assert trees["pubmed", "main"].items[1:] == (Range("date", "2018-01-01", "2026-02-28"), Facet("subset", "free full text"), Facet("language", "English"))
    assert [len(x.items) for x in trees["scopus", "main"].items[0].items] == [20, 16, 14]
    assert trees["scopus", "main"].items[1:] == (Range("year", "2018", "9999"), Facet("open_access", "1"), Facet("language", "English"))
    assert blocks("semantic_scholar") == [13, 13, 10] and blocks("europepmc") == [17, 14, 11]
    assert [len(x.items) for x in trees["springernature", "main"].items[0].items] == [20, 14, 14]
    assert [len(x.items) for x in trees["arxiv", "primary"].items[0].items] == [11, 12, 8] and len(trees["arxiv", "primary"].items[1].items) == 6
    assert trees["google_scholar", "gs_q2"] == And((Term("GPT"), Term("single cell"), Term("gene expression"), Term("generative")))


def test_facets_without_a_column_decide_nothing(rows):
    df = rows([("single cell", None, "2018"), ("single gene", None, "2017")], "title string, abstract string, year string")
    columns = {"title": F.col("title"), "abstract": F.col("abstract"), "year": F.col("year")}

    def found(query):
        return sorted(r["title"] for r in df.filter(search(query, "scopus", columns)).collect())

    assert found("cell AND NOT LANGUAGE(German)") == ["single cell"]
    assert found("NOT (LANGUAGE(German) AND gene)") == ["single cell", "single gene"]
    assert found("single AND(cell OR gene) AND PUBYEAR >= 2018") == ["single cell"]
    assert found('single AND PUBYEAR <= 2017 AND LIMIT-TO(DOCTYPE,"ar")') == ["single gene"]
