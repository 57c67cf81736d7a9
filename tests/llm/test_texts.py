import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblioflux.llm import leakage, lookalikes, packing, text_quality, truncation

# ---- look-alikes -------------------------------------------------------------------------------------------------------------


def test_rewriting(rows):
    cases = {
        "Ｌａｎｇｕａｇｅ model": "Language model", "Nørthwen\xa0Tidra": "Nørthwen Tidra", "e\u0301te\u0301": "été", "De\u200bdul\u00adiku": "Deduliku", "Trоlin": "Trolin", "ЅМАLL": "SMALL",
        "II II first fine profile": "II II first fine profile", "𝐏rompt 𝒎odel": "Prompt model", "ﬁne proﬁles": "fine profiles", "Phase Ⅱ": "Phase II", "Օmni cells": "Omni cells", "ᎪTLAS": "ATLAS", "mode\u04cf": "model", "Մարդ cell": "Մարդ cell",
        "TGFβ and γδ T cells": "TGFβ and γδ T cells", "Громыхова Велта": "Громыхова Велта", "Βαλτοράκη Μένη": "Βαλτοράκη Μένη", "Tölquіpur WЕ": "Tölquipur WE", "Lee, Н": "Lee, Н",
        "Zed Н": "Zed H", "а\u0301b": "áb", "Dӧr": "Dör", "Müller\tglia\n": "Müller\tglia\n", "plain": "plain",
    }
    data = [(k, v, None, "clash") for k, v in enumerate(cases)] + [(97, "The quick brown fox jumps over a lazy dog. THE QUICK BROWN FOX JUMPS OVER A LAZY DOG é ö á ü ø é ö á ü " * 9, "", "c"), (98, None, "", "c"), (99, "ab" * 30_000 + "\u200b", "x", "c")]
    df = rows(data, "id long, title string, other string, changed string")
    got = {r["id"]: r for r in lookalikes.consistent(df, ["title", "other"]).collect()}
    for k, (v, want) in enumerate(cases.items()):
        assert got[k]["title"] == want, v
        assert got[k]["changed"] == (["title"] if v != want else []), v
    assert got[98]["title"] is None and got[98]["changed"] == [] and got[99]["title"] == "ab" * 30_000
    assert lookalikes.consistent(df.limit(0), ["title", "other"]).collect() == []


def test_classes_are_disjoint_and_transitive():
    seen = set()
    for members in lookalikes.lookalike_classes().values():
        assert not seen & set(members)
        seen |= set(members)
    same = next(set(m) for m in lookalikes.lookalike_classes().values() if "é" in m)
    assert {"e\u0301", "е\u0301"} <= same


def test_the_frequent_form_represents():
    reps = lookalikes.representatives({"а": 9, "a": 1, "\xa0": 5, " ": 2})
    assert reps["a"] == "а" and reps[" "] == "\xa0" and reps["\u200b"] == ""


# ---- truncation --------------------------------------------------------------------------------------------------------------

SENTENCES = ["The cells were counted in all samples", "We compared the model with a linear baseline", "Training took 52 hours on six nodes", "The tool is free for reuse", "Results were stable under label noise"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [". ".join(rng.choices(SENTENCES, k=5)) + "." for _ in range(n)]


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("Results were stable under label noise. The cells were coun", True), ("Results were stable under label noise. We compared the model with", True), ("Results were stable. The tool is free for reuse", False),
        ("The tool is free for reuse. Training took…", True), ("The tool is free for reuse. Training to [...]", True), ("The tool is free for reuse. Training took ... (more)", True),
        ("The tool is free for reuse. The <su", True), ("The tool is free for reuse. The &lt;su", True), ("The tool is free for reuse. The &am", True), ("<p>The tool is free for reuse.</p>", False),
        ("The tool is free for reuse. Code: https://code.example/abc", False), ("The tool is free for reuse. Keywords: cells, models", False), ("The tool is free for reuse. (Funded by the trust, grant 5)", False),
        ("No abstract available", False), ("[Not available].", False), ("n/a", False), ("", False), (None, False), ("The tool is free for reuse.", False), ("The tool is free for reuse.\nTraining took", True),
    ],
)
def test_endings(spark, text, cut):
    data = [(k, t, "s", 0) for k, t in enumerate(corpus())] + [(999, text, None, 0)]
    df = spark.createDataFrame(data, "id long, abstract string, source string, is_cut int")
    got = truncation.cut_records(df, "id", "abstract", "source", judged=df.filter("id = 999")).collect()
    assert [(r["id"], r["is_cut"]) for r in got] == [(999, cut)]


def test_shares_and_no_rows(spark):
    data = [(k, t, "s") for k, t in enumerate(corpus())] + [(100, "The cells were cou", "s"), (101, "x" * 100_000, "long"), (101, "x" * 100_000, "long")]
    df = spark.createDataFrame(data, "id long, abstract string, source string")
    shares = {r["source"]: (r["n_texts"], r["n_cut"]) for r in truncation.cut_shares(truncation.cut_records(df, "id", "abstract", "source"), "source").collect()}
    assert shares["s"] == (61, 1) and shares["long"][0] == 2
    assert truncation.cut_records(df.limit(0), "id", "abstract", "source").collect() == []


# ---- packing -----------------------------------------------------------------------------------------------------------------


def best_sum(lengths, room):
    reach = {0}
    for n in lengths:
        reach |= {x + n for x in reach if x + n <= room}
    return max(reach)


def test_fullest_is_the_fullest():
    rng = random.Random(6)
    for _ in range(300):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 80)
        counts = {n: items.count(n) for n in items}
        got = packing.fullest(sorted(counts), counts, room)
        assert sum(got) == best_sum(items, room) and all(got.count(n) <= counts[n] for n in got)


def test_packs_hold_everything_once(spark):
    rng = random.Random(8)
    sizes = [(k, rng.choice([0, 1, 7, 100, 512, 513, 2000, rng.randint(1, 400)])) for k in range(900)] + [(5, 33), (5, 33), (None, 9), (7, None)]
    df = spark.createDataFrame([(*s, "clash") for s in sizes], "doc_id long, n_tokens long, pack_id string")
    caps = spark.createDataFrame([(1, 512), (2, 100), (3, 0)], "cap_id long, capacity long")
    got = packing.pack_documents(df, "doc_id", "n_tokens", caps, "cap_id", "capacity", shard=64).toPandas()
    usable = [n for k, n in sizes if k is not None and n]
    for cap_id, cap in ((1, 512), (2, 100)):
        own = got[got.cap_id == cap_id]
        assert own.groupby("pack_id").n_tokens.sum().max() <= cap and own.n_tokens.min() > 0
        assert own.n_tokens.sum() == sum(usable) and len(own) == sum(-(-n // cap) for n in usable)
        whole = own[own.groupby("doc_id").piece.transform("max") == 1]
        assert (whole.n_tokens <= cap).all()
    assert set(got.cap_id) == {1, 2}
    first = got[got.cap_id == 1]
    assert first.n_tokens.sum() / (first.pack_id.nunique() * 512) > 0.97
    assert packing.pack_documents(df.limit(0), "doc_id", "n_tokens", caps, "cap_id", "capacity").collect() == []


def test_token_counts(rows):
    df = rows([(1, "Two words"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "é" * 1000), (None, "x"), (2**60 + 1, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[2**60 + 1] == 1 and None not in got and got[4] > 1 and got[5] >= 500


# ---- leakage -----------------------------------------------------------------------------------------------------------------


def brute_overlap(doc, item):
    for offset in range(-len(item), len(doc)):
        same = [0 <= k + offset < len(doc) and doc[k + offset] == w for k, w in enumerate(item)]
        for share, least in leakage.LIMITS:
            for i in range(len(item)):
                for j in range(i + least, len(item) + 1):
                    if same[i:j].count(False) <= share * (j - i) + 1e-9:
                        return True
    return False


def test_overlaps_against_brute_force():
    rng = random.Random(9)
    hashes = leakage.Hashes()
    for _ in range(60):
        item = [f"w{rng.randrange(60)}" for _ in range(rng.randint(10, 45))]
        part = item[rng.randint(0, 5) :][: rng.randint(10, 45)]
        part = [w if rng.random() > 0.08 else "changed" for w in part]
        doc = [f"d{k}" for k in range(rng.randint(0, 6))] + part + ["end"]
        a, b = hashes.of(doc), hashes.of(item)
        assert any(leakage.overlaps(a, b, o) for o in range(-len(item), len(doc))) == brute_overlap(doc, item)


PASSAGE = "In the held-out arm four readers matched 585,065 captions of naïve T cells to screens and half of them named the marker without any help from the model"


@pytest.mark.parametrize("bits", [1 << 30, 1 << 11])
def test_leaks_in_every_disguise(rows, monkeypatch, bits):
    monkeypatch.setattr(leakage, "MAX_FILTER_BITS", bits)  # the lower one makes several blocks
    words = PASSAGE.split()
    hidden = [
        PASSAGE, PASSAGE.upper(), "Before. " + " ".join(words[3:20]) + " after", PASSAGE.replace(" ", "\n"), PASSAGE.replace("captions", "cap-\ntions").replace("readers", "<b>readers</b>").replace("screens", "screens [12]"),
        PASSAGE.replace("four", "seven").replace("half", "most"), "“" + PASSAGE.replace("held-out", "held‐out") + "”",
    ]
    clean = ["Nothing here", " ".join(words[:12]), " ".join(words[:10]) + " and other " + " ".join(words[14:22]), None, "", "stock wording of the prompt " * 20, "x " * 40_000]
    docs = rows([(k, t, 1) for k, t in enumerate(hidden + clean)] + [(0, PASSAGE, 1), (None, PASSAGE, 1)], "doc_id long, text string, item_id int")
    items = rows([(7, PASSAGE, "p"), (8, "too short", "p"), (9, None, "p"), (7, PASSAGE, "p"), (None, PASSAGE, "p")], "item_id long, passage string, doc_id string")
    got = leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()
    assert sorted(tuple(r) for r in got) == [(k, 7) for k in range(len(hidden))]
    assert leakage.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "passage").collect() == []
    assert leakage.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "passage").collect() == []


def test_short_wholes_with_a_changed_word(rows):
    words = PASSAGE.split()
    part, short = " ".join([*words[4:11], "changed", *words[12:19]]), " ".join(words[:16])
    docs = rows([(1, part), (2, "before " + part + " after"), (3, "before " + short.replace("readers", "raters") + " after"), (4, short.replace("four readers", "six raters"))], "doc_id long, text string")
    items = rows([(7, PASSAGE), (8, short)], "item_id long, passage string")
    got = leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()
    # a whole document of 15 words, a whole passage of 16; a part inside a longer text, or two changed words of 16, aren't enough
    assert sorted(tuple(r) for r in got) == [(1, 7), (3, 8)]


def test_passages_of_few_words_are_found_whole(rows):
    words = PASSAGE.split()
    docs = rows([(k, f"some text before {' '.join(words[:n])} and behind it", "x") for k, n in enumerate((1, 5, 8, 11, 14))] + [(9, "Unrelated words only", "x")], "doc_id long, text string, item string")
    items = rows([(n, " ".join(words[:n])) for n in (5, 8, 11)] + [(30, "a b"), (31, "."), (32, "")], "item_id long, passage string")
    got = sorted(tuple(r) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect())
    assert got == [(1, 5), (2, 5), (2, 8), (3, 5), (3, 8), (3, 11), (4, 5), (4, 8), (4, 11)]


def test_a_filter_holds_all_its_seeds(spark):
    rng = np.random.default_rng(1)
    seed = rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)
    df = spark.createDataFrame([(int(x),) for x in seed[:20_000]], "seed long")
    filled = leakage.seed_filter(df, 1 << 20)
    hits = leakage.might_hold(filled, seed.astype(np.uint64))
    assert set(range(20_000)) <= set(hits.tolist()) and len(hits) < 20_100


def test_seeds_ignore_masked_positions():
    hashes = leakage.Hashes()
    a, b = (hashes.of(s.split()) for s in ("a b c d e f g h", "a b X d e X g h"))
    (first, _), (second, _) = leakage.seeds(a)[0], leakage.seeds(b)[0]
    assert np.array_equal(first, second)


# ---- text quality ------------------------------------------------------------------------------------------------------------

PROSE = "The cells were counted in all of the samples, and we compared the model with a baseline. It is not known whether this helps."


@pytest.mark.parametrize(
    ("text", "form"),
    [
        (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.replace(" ", "\n", 3), "prose"), (f"<p>{PROSE}</p>", "prose"), ("El modelo es una de las mejores opciones para el estudio de los datos.", "prose"),
        (PROSE + "\n- one\n- two\n- three\n" + PROSE, "prose"), ("A single sentence is here.", "prose"),
        ("- one cell\n- two cells\n- three mice\n- four mice", "list"), ("KC77; GMM80; DCB3; QPQ71; XLV1; GT24", "list"), ("Terms\n[1] batch correction\n[2] donor matching\n[3] cell states", "list"),
        ("References\nDoe J, Roe K. A study of cells and their states in mice. J. Cells 2020;12.\nLee A. Models of text. Ann. Data 2021;4.", "list"),
        ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"), ("model,data,value\nx,y,1\nz,w,2", "table"), ("| a | b |\n| --- | --- |\n| 1 | 2 |", "table"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "table"),
        ("name      gene   n\nalpha     XY1    22\nbeta      ZZ3    9", "table"),
        ("0dPg2zznRXBO2lB2n51feW5MyYviLTL81zDwkum+yoylmUWf/rcKbc4EnJrcWbKX", "junk"), ("x " * 60, "junk"), ("loading..." * 20, "junk"), ("ACGTACGTTTGACCANNNACGTACGTACGTTAGC\nACGTACGTTTGACCANNNACGTACGTACGTTAGC", "junk"),
        ("Home | Login | Help | Home | Terms | Login | Help | Home | Share | Login", "junk"), ('{"a":{"id":1,"v":[2,3]},"b":{"id":4,"v":[5]}}', "junk"),
        ("2026-02-07T20:00:00Z GET /a?p=3 500 0x32fccfbe\n2026-02-13T11:40:00Z INFO /b 500 0x14fc6d13", "junk"), ("#!=\\+!/>?<@%+!|?=@&~%.$@.*\\.&+@.\\|~=<>^!@", "junk"), (None, None), ("", None), (" \n\u200b", None),
    ],
)
def test_forms(rows, text, form):
    words = rows([(w,) for w in "the of in and we is it with all not this was were a to whether el es una de las los para".split()], "word string")
    df = rows([(1, text, "clash")], "doc_id long, text string, form string")
    assert text_quality.text_forms(df, "text", words).first()["form"] == form


def test_statistics_and_reasons(rows):
    words = rows([("the",), (None,)], "word string")
    df = rows([(1, "The cat.\n- the dog\n\nx 12%"), (2, None), (3, "word " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in text_quality.text_forms(df, "text", words).collect()}
    one = got[1]
    assert (one["n_words"], one["n_lines"]) == (7, 3)
    assert one["common_share"] == pytest.approx(2 / 6) and one["end_punctuation_share"] == pytest.approx(1 / 3) and one["bullet_share"] == pytest.approx(1 / 3)
    assert one["mean_word_length"] == pytest.approx(18 / 7) and one["letter_word_share"] == pytest.approx(5 / 7)
    assert "fewer than 50 words [G]" in one["reasons"] and "fewer than 50 words [G]" not in got[3]["reasons"]
    assert "fewer than 80 % of words have a letter [G]" in one["reasons"]
    assert got[2]["n_words"] == 0 and got[2]["form"] is None and got[3]["form"] == "junk"
    assert text_quality.text_forms(df.limit(0), "text", words).collect() == []


def test_a_word_list_has_a_bound(rows, monkeypatch):
    monkeypatch.setattr(text_quality, "MAX_WORDS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        text_quality.text_forms(rows([(1, "a")], "doc_id long, text string"), "text", rows([("a",), ("b",), ("c",)], "word string"))


def test_suspect_pattern_covers_all_members(rows):
    members = lookalikes.INVISIBLE + lookalikes.SPACES + lookalikes.WIDE + list(lookalikes.POSING)
    df = rows([(m,) for m in members], "m string").filter(~F.col("m").rlike(lookalikes.SUSPECT))
    assert df.collect() == []


def test_packs_are_the_same_on_every_run(rows):
    data = [(k % 300, 1 + k * 7919 % 900) for k in range(600)] + [(5, 40), (5, 40)]
    caps = rows([(1, 256), (2, 100)], "c long, cap long")

    def packs(parts):
        df = rows(data, "d long, n long").repartition(parts)
        return sorted(tuple(r) for r in packing.pack_documents(df, "d", "n", caps, "c", "cap", shard=64).collect())

    first = packs(3)
    assert first == packs(7)
    assert sum(r[4] for r in first if r[0] == 1) == sum(n for _, n in data)
