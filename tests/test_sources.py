import json

import pytest
from pyspark.sql import functions as F

from biblioflux.schema import UNIFIED
from biblioflux.sources import exports, paged, payloads, sinks


@pytest.fixture
def folder(tmp_path):
    put = lambda name, data: (tmp_path / name).write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    put("pubmed_2026-01-01.json", {"records": []})
    put("pubmed_2026-02-15.json", {"database": "pubmed", "records": [{"pmid": " 1 ", "doi": "https://doi.org/10.1/A", "title": " Ä <i>b</i> ", "abstract": None, "authors": "X Y; Z W", "year": "2020", "journal": "J"}, {"title": "second"}]})
    put("semantic_scholar_2026-02-15.json", {"records": [{"s2_id": "s", "arxiv_id": "2101.00001v2", "year": 2021, "venue": "", "open_access_pdf": "u", "authors": "A"}]})
    put("springernature_2026-02-15.json", [{"title": "raw"}])
    put("springernature_filtered_2026-02-15.json", {"records": [{"title": "valid", "authors": ["P Q", "R S"], "abstract": {"p": "x"}, "publicationDate": "2020-01-02", "publicationName": "SN"}]})
    put("google_scholar_2026-02-15.json", [{"title": "bare", "authors": [], "year": "2019"}])
    put("scopus_2026-02-15.json", "neither")
    put("biorxiv_medrxiv_2026-02-15.json", {"records": [{"epmc_id": "PPR1", "title": "t", "extra": {"deep": [1]}}]})
    return tmp_path


def test_exports(spark, folder):
    assert exports.latest_date(str(folder)) == "2026-02-15"
    assert exports.export_files(str(folder), "2026-02-15", filtered_springernature=False)["springernature"].endswith("springernature_2026-02-15.json")
    got = exports.load_exports(spark, str(folder))
    assert got.columns == ["pos", *UNIFIED]
    by = {(r["source_db"], r["title_original"]): r for r in got.collect()}
    assert set(by) == {("pubmed", "Ä <i>b</i>"), ("pubmed", "second"), ("semantic_scholar", ""), ("springernature", "valid"), ("google_scholar", "bare"), ("biorxiv_medrxiv", "t")}
    p = by["pubmed", "Ä <i>b</i>"]
    assert (p["pmid"], p["doi_normalized"], p["doi_original"], p["title_normalized"], p["abstract"], p["venue"], p["scopus_id"]) == ("1", "10.1/a", "https://doi.org/10.1/A", "ä b", "", "J", None)
    s = by["semantic_scholar", ""]
    assert (s["arxiv_id_normalized"], s["year"], s["url"], s["venue"]) == ("2101.00001", "2021", "u", "")
    n = by["springernature", "valid"]
    assert (n["authors"], n["abstract"], n["date"], n["venue"]) == ("P Q; R S", "", "2020-01-02", "SN")
    assert by["biorxiv_medrxiv", "t"]["epmc_id"] == "PPR1" and by["pubmed", "second"]["epmc_id"] is None


def test_missing_exports(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        exports.load_exports(spark, str(tmp_path))


def test_pubmed_xml(rows):
    xml = """<PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J</Title></Journal>
    <ArticleTitle>A title</ArticleTitle><Abstract><AbstractText Label="X">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
    <AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>G</CollectiveName></Author><Author><LastName>Roe</LastName></Author></AuthorList></Article></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
    got = payloads.pubmed(rows([(xml,), ("<PubmedArticle><MedlineCitation><PMID>8</PMID></MedlineCitation></PubmedArticle>",)], "x string"), "x").collect()
    assert len(got) == 1
    r = got[0].asDict()
    assert r == {"pmid": "7", "doi": "10.1/x", "title": "A title", "abstract": "One. Two.", "authors": "Doe Jo; Roe", "year": "2020", "month": "", "journal": "J", "source": "pubmed"}


def test_atom_entry(rows):
    xml = """<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.example/abs/2301.12345v1</id><title>A
 b</title><summary> S
t </summary><published>2023-01-02T00:00:00Z</published><author><name>X Y</name></author><author><name>Z</name></author><category term="cs.LG"/><category term="q-bio"/>
 <link href="a"/><link title="doi" href="10.1/q"/></entry>"""
    r = payloads.arxiv(rows([(xml,)], "x string"), "x").first().asDict()
    assert (r["arxiv_id"], r["doi"], r["title"], r["abstract"], r["authors"], r["date"], r["year"], r["categories"]) == ("2301.12345v1", "10.1/q", "A  b", "S t", "X Y; Z", "2023-01-02", "2023", ["cs.LG", "q-bio"])


def test_json_payloads(rows):
    one = lambda make, item: make(rows([(json.dumps(item),)], "x string"), "x").first().asDict()
    assert one(payloads.scopus, {"dc:identifier": "SCOPUS_ID:5", "prism:coverDate": "2020-05-06"}) == {"scopus_id": "5", "doi": "", "title": "", "authors": "", "journal": "", "year": "2020", "date": "2020-05-06", "cited_by": "0", "source": "scopus"}
    s = one(payloads.semantic_scholar, {"paperId": "p", "externalIds": {"DOI": "d", "PubMed": "1"}, "authors": [{"name": "A"}, {"name": "B"}], "year": 2020, "openAccessPdf": None})
    assert (s["doi"], s["pmid"], s["arxiv_id"], s["authors"], s["year"], s["open_access_pdf"], s["fields_of_study"]) == ("d", "1", "", "A; B", 2020, "", [])
    assert one(payloads.europepmc, {"id": "PPR1", "source": "PPR"})["source_db"] == "PPR"
    n = one(payloads.springernature, {"identifier": "doi:10.1/z", "creators": [{"creator": "Q"}], "url": [{"value": "v"}], "abstract": {"p": "t"}})
    assert (n["doi"], n["authors"], n["url"], n["abstract"]) == ("10.1/z", ["Q"], "v", '{"p":"t"}')
    assert one(payloads.springernature, {"doi": "d", "creators": "text"})["authors"] == []


def test_google_scholar_payload(spark, rows):
    one = lambda item: payloads.google_scholar(rows([(json.dumps(item),)], "x string"), "x", "gs_q1").first().asDict()
    bib = {"title": "A [title]", "author": ["X Y", "Z"], "pub_year": 2021, "abstract": "text", "venue": "J"}
    assert one({"bib": bib, "eprint_url": "e", "num_citations": 3, "citedby_url": "/c"}) == {
        "source": "google_scholar", "query_id": "gs_q1", "title": "A [title]", "authors": ["X Y", "Z"], "year": "2021", "abstract": "text", "venue": "J", "url": "e", "num_citations": 3, "citedby_url": "/c",
    }
    assert one({"bib": {"author": "X Y"}, "pub_url": "p", "eprint_url": "e"})["url"] == "p" and one({"bib": {"author": "X Y"}})["authors"] == ["X Y"]
    empty = one({"other": 1})
    assert (empty["title"], empty["authors"], empty["year"], empty["url"], empty["num_citations"]) == ("", [], "", "", 0)


def test_paged_source(spark, tmp_path):
    for page in range(5):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"hits": {"items": [{"id": page * 2 + k} for k in range(2)]}}))
    spark.dataSource.register(paged.PagedSource)
    options = {"url": f"file://{tmp_path}/p{{page}}.json", "total": 12, "pageSize": 2, "items": "hits.items", "pagesPerTask": 2, "delay": 0}
    df = spark.read.format("paged").options(**options).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted(json.loads(r["item"])["id"] for r in df.collect()) == list(range(10))  # the sixth page is missing


def test_pages_in_sequence(spark, tmp_path):
    put = lambda name, ids, **more: (tmp_path / f"{name}.json").write_text(json.dumps({"data": [{"id": k} for k in ids], **more}))
    spark.dataSource.register(paged.PagedSource)

    def read(**options):
        df = spark.read.format("paged").options(items="data", delay=0, retries=1, **options).load()
        return [(r["page"], r["pos"], json.loads(r["item"])["id"]) for r in df.collect()]

    # a token leads on, over an empty page too; the last page has none
    put("t", [0, 1], meta={"next": "a"}), put("t-a", [], meta={"next": "b"}), put("t-b", [2], meta={"next": None})
    url = f"file://{tmp_path}/t-{{token}}.json"
    assert read(url=url, firstUrl=f"file://{tmp_path}/t.json", next="meta.next") == [(0, 0, 0), (0, 1, 1), (2, 0, 2)]
    # a cursor that stays the same ends the pages
    put("c-s", [0], mark="x+y"), put("c-x+y", [1], mark="x+y")
    assert read(url=f"file://{tmp_path}/c-{{token}}.json", first="s", next="mark") == [(0, 0, 0), (1, 0, 1)]
    # a short page ends the offset pages
    put("o-0", [0, 1]), put("o-2", [2, 3]), put("o-4", [4]), put("o-6", [5])
    assert [r[2] for r in read(url=f"file://{tmp_path}/o-{{offset}}.json", pageSize=2)] == [0, 1, 2, 3, 4]
    # a lost page fails
    put("t-a", [9], meta={"next": "lost"})
    with pytest.raises(Exception, match="isn't there"):
        read(url=url, firstUrl=f"file://{tmp_path}/t.json", next="meta.next")
    with pytest.raises(Exception, match="isn't there"):
        read(url=f"file://{tmp_path}/o-{{offset}}.json", pageSize=2, total=20, missing="fail")


def test_retries():
    waits = []
    answers = iter([(429, ""), (500, ""), (200, "ok")])
    assert paged.fetch_with_retry("u", get=lambda _: next(answers), sleep=waits.append) == "ok" and waits == [2.0, 2.0]
    assert paged.fetch_with_retry("u", get=lambda _: (404, ""), sleep=waits.append) is None
    with pytest.raises(RuntimeError):
        paged.fetch_with_retry("u", get=lambda _: (429, ""), sleep=waits.append)

    def broken(_):
        raise OSError

    with pytest.raises(OSError):
        paged.fetch_with_retry("u", get=broken, sleep=waits.append)


def test_sinks(spark, rows, tmp_path):
    log = rows([("MERGE", 'say "x", y', 1, "db", None, "d", "", "")], "action string, reason string, cluster_id long, source_db string, title string, doi string, matched_with_db string, matched_with_title string")
    sinks.write_log(log.select(*reversed(log.columns)), f"{tmp_path}/log")
    back = spark.read.csv(f"{tmp_path}/log", header=True, escape='"')
    assert back.columns == sinks.LOG_COLUMNS and back.first()["reason"] == 'say "x", y'
    sinks.write_records(log, f"{tmp_path}/r")
    with pytest.raises(Exception, match="exists"):
        sinks.write_records(log, f"{tmp_path}/r")
    doc = json.loads(sinks.document(stats=rows([("b", 2), ("a", None)], "k string, n long")))
    assert doc == {"stats": [{"k": "a", "n": None}, {"k": "b", "n": 2}]}
    with pytest.raises(ValueError, match="more than"):
        sinks.document(big=spark.range(sinks.MAX_DOCUMENT_ROWS + 1).select(F.col("id")))
