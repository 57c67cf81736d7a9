import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioflux.functions.identifiers import canonical_doi
from biblioflux.llm import components, format_duplicates
from biblioflux.llm.record_survivors import surviving_fields
from biblioflux.llm.survivors import best_values, closest, consensus, lcs_pairs

# ---- copies ------------------------------------------------------------------------------------------------------------------


def test_copies_of_every_formatting(rows):
    data = [
        (1, "A Study: of Cells", "10.1101/x1"), (2, "a  study of-cells.", "https://doi.example/10.1101%2FX1"), (3, "10.1101/x1", "A study of cells"), (4, "A study of cells", None),
        (5, "A study of cells", "n/a"), (6, "A study of cells", "10.1101/x2"), (7, None, "10.1101/x1"), (8, "", ""), (9, "-", "10.1101/x1"), (10, "n/a", None), (11, "Ä", ""), (12, "ä", "none"),
        (13, "A\u200b study of cells", "DOI: 10.1101/x1."),
    ]
    df = rows(data, "id long, title string, doi string").withColumn("first_id", F.lit("clash"))
    got = format_duplicates.copy_groups(df, "id", format_duplicates.canonical_key(F.col("title"), F.col("doi"))).collect()
    assert {r["id"]: (r["first_id"], r["n_copies"]) for r in got} == {
        1: (1, 4), 2: (1, 4), 3: (1, 4), 13: (1, 4), 4: (4, 2), 5: (4, 2), 6: (6, 1), 7: (7, 1), 8: (8, 1), 9: (9, 1), 10: (10, 1), 11: (11, 2), 12: (11, 2),
    }


def test_copies_against_brute_force_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr("biblioflux.operators.skew.HOT_ROWS", 50)
    rng = random.Random(3)
    keys = ["hot" if rng.random() < 0.4 else f"t{rng.randrange(900)}" for _ in range(1500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(keys)], "id long, key string")
    got = {r["id"]: (r["first_id"], r["n_copies"]) for r in format_duplicates.copy_groups(df, "id", F.col("key")).collect()}
    assert got == {k: (keys.index(t), keys.count(t)) for k, t in enumerate(keys)}
    collapsed = format_duplicates.collapse_copies(df, "id", F.col("key")).collect()
    assert len(collapsed) == len(set(keys)) and sum(r["n_copies"] for r in collapsed) == len(keys)


@pytest.mark.parametrize("size", [2_000, 8_000, 32_000])
def test_filters_by_range_let_few_singletons_through_at_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(format_duplicates, "ROWS_PER_RANGE", 2000)
    monkeypatch.setattr(format_duplicates, "SEGMENT_BITS", 1 << 12)
    df = spark.range(size).select("id", F.concat(F.lit("k"), F.when(F.col("id") % 10 == 0, F.col("id") - F.col("id") % 20).otherwise(F.col("id"))).alias("key"), F.lit(1).alias("hash_range"))
    got = {r["id"]: r["__again"] for r in format_duplicates.marked_rows(df.repartition(5), "id", F.col("key")).collect()}
    assert len(got) == size and all(got[k] for k in range(0, size, 10))
    single = [again for k, again in got.items() if k % 10]
    assert sum(single) / len(single) < 0.01


def test_filter_bits_are_in_proportion():
    assert [format_duplicates.filter_bits(n) for n in (0, 256, 257, 1 << 25)] == [1 << 12, 1 << 12, 1 << 13, 1 << 29]


def test_positions_are_listed_or_packed():
    few, many = np.array([3, 900]), np.arange(0, 4096, 3)
    for at in (few, many, few[:0]):
        assert np.array_equal(format_duplicates._decode(format_duplicates._encode(at, 4096)), at)


def test_no_rows(rows):
    df = rows([], "id long, key string")
    assert format_duplicates.copy_groups(df, "id", F.col("key")).collect() == []


# ---- components --------------------------------------------------------------------------------------------------------------


def brute_components(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "loops"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(7)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "chain": [(k, k + 1) for k in range(60)], "star": [(500, k) for k in range(80)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4)],
    }[shape]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = brute_components([(a, b) for a, b in edges if a is not None and a != b])
    assert {r["node"]: r["group_id"] for r in got} == want and len(got) == len(want)


def test_records_match_by_any_identifier(rows):
    ddl = "cluster_id long, doi string, pmid string, arxiv_id string, title_normalized string, group_id string"
    data = [
        (1, "10.1101/a", None, None, "x one"), (2, "DOI:10.1101/A", "77", "", "x two"), (3, None, "PMID: 0077", None, ""), (4, "n/a", "N/A", "arXiv:2101.00001v2", "editorial"),
        (5, "-", "0", "2101.00001", "editorial"), (6, "", None, "none", "editorial"), (7, None, None, None, None), (8, "10.1101/b", "", "", "same title"), (9, "none", "null", "", "same title"),
        (10, None, None, None, "Same title"),
    ]
    got = components.record_groups(rows([(*d, "clash") for d in data], ddl)).collect()
    assert {r["cluster_id"]: r["group_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8}
    assert components.record_groups(rows([], ddl)).collect() == []


def test_hot_key_keeps_its_records(spark):
    df = spark.range(3000).select(F.col("id").alias("cluster_id"), F.when(F.col("id") % 3 == 0, "10.1101/hot").otherwise(F.concat(F.lit("10.1101/"), F.col("id"))).alias("doi"),
                                  F.lit(None).cast("string").alias("pmid"), F.lit("").alias("arxiv_id"), F.lit("").alias("title_normalized"))
    got = components.record_groups(df)
    assert got.count() == 1000 and got.filter("group_id = 0").count() == 1000


# ---- survivors ---------------------------------------------------------------------------------------------------------------


def test_lcs_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = lcs_pairs(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_votes():
    values = [s.split() for s in ("the cell atlas of man", "the cell atlas of mice", "the atlas of mice", "a cell atlas of mice")]
    assert consensus(values, [1, 1, 1, 1]) == "the cell atlas of mice".split()
    assert closest(values, [1, 1, 1, 1]) == 1
    assert closest(values, [8, 4, 2, 1]) == 0  # the first outweighs the rest
    assert closest(values, [8, 4, 2, 1], [1, 0, 0, 0]) == 1  # a less trusted value votes, but doesn't survive
    assert consensus([[], ["a"]], [2, 1]) == ["a"] and closest([["x"]], [1]) == 0  # a gap casts no vote


def test_votes_beat_the_first_rank():
    values = [s.split() for s in ("the call atlas if mice and men today", "the cell atlas of mice and men", "the cell atlas of mice")]
    assert consensus(values, [1, 1, 1]) == "the cell atlas of mice and men today".split()
    assert closest(values, [1, 1, 1]) == 1
    assert closest(values, [3, 1, 1]) == 0


@pytest.mark.parametrize("block", [8, 64])
def test_best_values_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr("biblioflux.llm.survivors.BLOCK", block)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    data = [(1, 500, " ".join(words[:-1]), 0), (1, 501, " ".join(words), 1)]  # the fullest trusted one, and a fuller one that isn't trusted
    for k in range(120):
        damaged = [f"x{rng.randrange(99)}" if rng.random() < 0.2 else w for w in words if rng.random() < 0.8]
        data.append((1, k, " ".join(damaged), 0))
    data += [(2, 7, "aa bb cc", 0), (2, 8, "aa bb dd", 0), (2, 9, "aa bb dd", 0), (3, 1, "z", 1), (3, 0, "z", 1), (4, 5, "left", 0), (4, 4, "right", 0)]
    df = spark.createDataFrame(data, "g int, id long, text string, level int")

    def kept(**how):
        return {r["g"]: r["id"] for r in best_values(df, ["g"], "id", "text", F.col("level"), F.lit(1), [F.col("id")], **how).collect()}

    assert kept() == {1: 500, 2: 8, 3: 0, 4: 4}
    assert kept(repeated=False) == {1: 500, 2: 7, 3: 0, 4: 4}
    assert best_values(df.limit(0), ["g"], "id", "text", F.col("level"), F.lit(1), [F.col("id")]).collect() == []


def test_surviving_fields(rows):
    whole = "Cells were counted in all samples. " * 3 + "Results were stable."
    cut = "Cells were counted in all samples. " * 5 + "Results were sta"
    ddl = "cluster_id long, title_normalized string, doi string, pmid string, arxiv_id string, abstract string, abstract_source string, venue string, sources array<string>, kept string"
    records = rows([
        (1, "t", "10.1101/p", "5", None, cut, "a", "HPH", ["x"], ""), (2, "u", "10.9999/q", "5", None, whole, "b", "annals of cells and  data", ["y", "x"], ""), (3, "v", None, "5", None, None, None, "Ann. Cells Data", None, ""),
        (4, "w", "10.1101/z", None, None, "", None, "-", [], ""), (5, "w", None, None, None, "No abstract available.", None, None, None, ""), (6, "lone", "", None, None, whole, "b", "HPH", ["x"], ""),
    ], ddl)
    venues = rows([("Annals of Cells & Data", "Ann. Cells Data", "journal"), ("Helix Preprint Hall", "HPH.", "preprint server")], "venue_name string, venue_abbrev string, venue_type string")
    got = {tuple(r) for r in surviving_fields(records, venues).collect()}
    assert got == {(1, "abstract", "2"), (1, "doi", "2"), (1, "venue", "2"), (1, "sources", "x"), (1, "sources", "y"), (4, "doi", "4")}
    assert surviving_fields(records.limit(0), venues).collect() == []


def test_doi_key_of_python_and_column_agree(rows):
    doi = " doi: 10.99007%2Fns/7; "
    got = rows([(doi,)], "d string").select(canonical_doi(F.col("d"))).first()[0]
    assert got == re.sub(r";$", "", "10.99007/ns/7;")
