import random

from pyspark.sql import functions as F

from biblioflux.operators import enrichment, filters, stats
from biblioflux.operators.title_match import similar_titles


def test_dates_of_every_precision(rows):
    dates = {"2026": True, "2027": False, "abcd": True, "2026-02": True, "2026-03": False, "2026/02": False, "2026-02-28": True, "2026-03-01": False, "": True, None: True, "2026-02-28T10:00": True}
    df = rows([(k, d) for k, d in enumerate(dates)], "k int, d string")
    assert [r[0] for r in df.orderBy("k").select(filters.within_cutoff(F.col("d"), "2026-02-28")).collect()] == list(dates.values())
    assert [r[0] for r in df.orderBy("k").select(filters.in_compact_range(F.col("d"), "20260101", "20260228")).collect()][6:9] == [True, False, True]


def test_abstract_length_and_split(rows):
    df = rows([(1, "x" * 10), (2, "x" * 11), (3, "  " + "x" * 10 + " "), (4, None), (5, "")], "id long, abstract string")
    kept, excluded = enrichment.split_by_abstract(df)
    assert [r["id"] for r in kept.collect()] == [2] and {r["exclusion_code"] for r in excluded.collect()} == {"EC_NO_ABSTRACT"}


def test_picks(rows):
    df = rows([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", 4, None)], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in filters.first_wins(df, "k", ["o"]).collect()) == [("a", "x"), ("b", None)]
    assert sorted((r["k"], r["v"], r["at"]) for r in filters.last_wins_first_place(df, "k", ["o"], "at").collect()) == [("a", "y", 1), ("b", None, 4)]
    assert [r["k"] for r in filters.unseen(df, rows([("a",)], "k string"), "k").collect()] == ["b"]


def test_blocks_ignore_case_of_special_letters(rows):
    df = rows([("KNN model",), ("knn Model",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(filters.all_blocks(F.col("t"), ["knn", "model"])).collect()] == [True, True, False, False]


def test_waterfall_asks_in_order(rows):
    records = rows([(1, "", "d1", "p1"), (2, None, "d2", "p2"), (3, "a long enough text", "d1", "p1"), (4, "", "", "")], "cluster_id long, abstract string, doi_key string, pmid_key string")
    doi = rows([("d1", "from doi"), ("d2", "")], "doi_key string, found string")
    pmid = rows([("p1", "from pmid"), ("p2", "from pmid 2")], "pmid_key string, found string")
    got = {r["cluster_id"]: (r["abstract"], r["abstract_source"]) for r in enrichment.waterfall(records, [("doi", doi, "doi_key"), ("pmid", pmid, "pmid_key")]).collect()}
    assert got == {1: ("from doi", "doi"), 2: ("from pmid 2", "pmid"), 3: ("a long enough text", None), 4: ("", None)}


def test_statistics(rows):
    golden = rows([(["a", "b", "c"],), (["a", "b"],), (["c"],)], "sources array<string>").withColumn("n_sources", F.size("sources"))
    assert {(r[0], r[1], r[2]) for r in stats.source_overlap(golden).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    assert {(r[0], r[1]) for r in stats.count_with_total(rows([("x",), ("x",), (None,)], "s string"), "s").collect()} == {("x", 2), ("unknown", 1), ("TOTAL", 3)}
    got = rows([(5534, 3555), (0, 0)], "a long, b long").select(stats.duplicate_rate(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [35.8, None]
    texts = rows([("scGPT here", "p"), ("none", "s"), (None, "s")], "t string, db string")
    assert {(r["name"], r["n_found"], r["found"]) for r in stats.name_recall(texts, ["scgpt", "x%"], F.col("t")).collect()} == {("scgpt", 1, True), ("x%", 0, False)}


def test_similar_titles_lose_no_link(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    titles = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(120)] + [(200, ""), (201, None), (202, titles_twin := "w1 w2 w3"), (203, titles_twin)]
    df = spark.createDataFrame(titles, "id long, title string")
    sets = {k: set((t or "").split()) for k, t in titles}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) > 0.8}
    got = similar_titles(df, df, "id", "title").collect()
    assert {(r["query_id"], r["id"]) for r in got} == want and len(got) == len(want)


def test_first_rows_and_missing(rows):
    df = rows([("a", 3, None), ("a", 1, "a long abstract"), ("a", 2, ""), ("b", 5, "short")], "k string, o int, abstract string")
    assert sorted((r["k"], r["o"]) for r in filters.first_k(df, "k", ["o"], 2).collect()) == [("a", 1), ("a", 2), ("b", 5)]
    assert [r["o"] for r in filters.first_missing(df, "abstract", "o", 2).collect()] == [2, 3]
    assert filters.first_missing(df, "abstract", "o").count() == 3
