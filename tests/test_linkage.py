import random

import pytest
from pyspark.sql import functions as F

from biblioflux.operators import linkage, skew, survivorship
from biblioflux.operators.positions import with_positions

KEYS = ["doi_normalized", "pmid", "arxiv_id_normalized", "title_normalized"]
DDL = "ord long, doi_normalized string, pmid string, arxiv_id_normalized string, title_normalized string"


def one_by_one(records):
    """Clusters and deciding keys of a record-by-record pass with one register per key."""
    registers = [{} for _ in KEYS]
    out, founders = {}, 0
    for ord_, *keys in sorted(records):
        hit = next(((k, registers[k][v]) for k, v in enumerate(keys) if v and v in registers[k]), None)
        if hit is None:
            cluster, founders = founders, founders + 1
        else:
            cluster = hit[1]
        out[ord_] = (cluster, None if hit is None else hit[0])
        for k, v in enumerate(keys):
            if v:
                registers[k].setdefault(v, cluster)
    return out


def linked(spark, records):
    return {r["ord"]: r for r in linkage.link(spark.createDataFrame(records, DDL)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_same_clusters_as_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, "", *[f"v{k}" for k in range(n)]])
    records = [(k, pick(60), pick(50), pick(40), pick(90)) for k in range(300)]
    want, got = one_by_one(records), linked(spark, records)
    assert {k: r["cluster_id"] for k, r in got.items()} == {k: c for k, (c, _) in want.items()}
    texts = ["DOI match: ", "PMID match: ", "arXiv ID match: ", "Exact title match"]
    assert all(r["reason"].startswith("No match found" if want[k][1] is None else texts[want[k][1]]) for k, r in got.items())


def test_a_bridge_merges_nothing(spark):
    got = linked(spark, [(0, "d1", "", "", ""), (1, "", "p1", "", ""), (2, "d1", "p1", "", ""), (3, "", "p1", "", "")])
    assert [got[k]["cluster_id"] for k in range(4)] == [0, 1, 0, 1]


def test_chain_and_empty_table(spark):
    chain = [(k, f"d{k}", "", "", f"t{k + 1}" if k % 2 else f"t{k}") for k in range(8)]
    want = one_by_one(chain)
    assert {k: r["cluster_id"] for k, r in linked(spark, chain).items()} == {k: c for k, (c, _) in want.items()}
    assert linked(spark, []) == {}


def test_hot_key_in_salted_join(spark):
    rows = spark.range(1000).select((F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("k"), "id")
    agg = rows.groupBy("k").agg(F.min("id").alias("m"), F.count("*").alias("n"))
    got = skew.join_aggregate(rows, agg, ["k"], "n", hot_rows=100)
    assert got.count() == 1000 and got.filter("k = 0 and m = 0").count() == 700


def test_positions(spark):
    df = spark.createDataFrame([(v,) for v in [5, 3, 3, 9, None, 1]], "v int")
    got = sorted((r["p"], r["v"]) for r in with_positions(df, ["v"], "p").collect())
    assert got == [(0, None), (1, 1), (2, 3), (3, 3), (4, 5), (5, 9)]


def test_survivors_and_links(spark):
    ddl = "cluster_id long, ord long, source_db string, title_original string, title_normalized string, doi_original string, doi_normalized string, pmid string, arxiv_id_original string, abstract string, authors string, year string, venue string, date string, url string"
    rec = lambda c, o, db, doi, abstract, pmid="": (c, o, db, f"T{o}", f"t{o}", doi, (doi or "").lower() or None, pmid, None, abstract, "A", "2020", None, "", "u")
    df = spark.createDataFrame([
        rec(0, 0, "arxiv", "10.1101/A", "long abstract"), rec(0, 1, "scopus", "10.9/B", ""), rec(0, 2, "pubmed", "", "long abstracT", "7"), rec(0, 3, "pubmed", "10.1101/a", "x"),
        rec(1, 4, "springernature", None, None), rec(2, 5, "arxiv", "10.1101/p", "y"),
    ], ddl)
    got = {r["cluster_id"]: r for r in survivorship.survivors(df).collect()}
    assert (got[0]["title"], got[0]["doi"], got[0]["preprint_doi"], got[0]["abstract"], got[0]["pmid"]) == ("T1", "10.9/B", "10.1101/A", "long abstract", "7")
    assert got[0]["sources"] == ["arxiv", "pubmed", "scopus"] and got[0]["duplicate_count"] == 4 and len(got[0]["all_dois"]) == 3
    assert (got[1]["doi"], got[1]["abstract"], got[1]["pmid"]) == ("", "", "") and got[2]["preprint_doi"] == ""
    links = survivorship.preprint_links(df).collect()
    assert [(r["cluster_id"], r["published_doi"], r["preprint_dois"], r["title"]) for r in links] == [(0, "10.9/b", ["10.1101/a", "10.1101/a"], "T0")]
    assert survivorship.survivors(df.limit(0)).collect() == []
