from biblioflux import queries

GOLDEN = "cluster_id long, doi string, pmid string, title string, abstract string"
SOURCE = "source_db string, doi_normalized string, pmid string, title_original string, abstract string"


def test_titles_fall_back_on_the_most_similar_one(rows, spark, tmp_path):
    w = [f"w{k}" for k in range(10)]
    title = " ".join(w)
    golden = [
        (1, "", None, title, None),  # equal title before a similar one
        (2, "", "", " ".join([*w[:9], "Other"]), ""),  # nine of ten words
        (3, "", "", " ".join([*w[:8], "x", "y"]), ""),  # eight of ten are not above 0.8
        (4, "10.1/a", "", " ".join([*w[:9], "doi"]), ""),  # an identifier: titles aren't asked
        (5, "", "", " ".join(["u1 u2 u3 u4 u5 u6"]), "short"),  # the nearer title first, then the least
        (6, "", "", " ".join([*w[:9], "Other"]), ""),
        (7, "", "", "", ""),
    ]
    source = [
        ("semantic_scholar", "", "", title.upper(), " the scholar's abstract "), ("semantic_scholar", "", "", title, "the scholar's later abstract"),
        ("semantic_scholar", "", "", title + " Other", None), ("pubmed", "", "9", title + " other", "not asked by title"),
        ("semantic_scholar", "", "", "u1 u2 u3 u4 u5 u6 b", "less than the other"), ("semantic_scholar", "", "", "u1 u2 u3 u4 u5 u6 a", "of the least title"),
        ("semantic_scholar", "", "", "u1 u2 u3 u4 u5", "an earlier title, less similar"), ("semantic_scholar", "", "", "u1 u2 u3 u4 u5 u6 0", "too short"),
    ]
    rows(golden, GOLDEN).write.parquet(f"{tmp_path}/deduplicated_records.parquet")
    rows(source, SOURCE).write.parquet(f"{tmp_path}/unified_records.parquet")
    got = {r["cluster_id"]: (r["abstract"], r["abstract_source"]) for r in queries.QUERIES["enrich_waterfall"](spark, str(tmp_path)).collect()}
    found = ("the scholar's abstract", "s2_title")
    assert got == {1: found, 2: found, 3: ("", None), 4: ("", None), 5: ("of the least title", "s2_title"), 6: found, 7: ("", None)}
