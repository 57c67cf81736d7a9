import pytest
from pyspark.sql import functions as F

from biblioflux.operators.packed_fields import ranking, split_field, split_packed

CASES = {
    "Branzetti W; von Glauzhwen D; ; Dalquelle DO;": ["Branzetti W", "von Glauzhwen D", "Dalquelle DO"],
    "Glün GC, Trap L, Hund M": ["Glün GC", "Trap L", "Hund M"],
    "Fera O. Sanz, Zané O. Traur and Skedrumi K. Darv": ["Fera O. Sanz", "Zané O. Traur", "Skedrumi K. Darv"],
    "['Djam, Kinane M.', 'Kivrelle, Vizé']": ["Djam, Kinane M.", "Kivrelle, Vizé"],
    '["Fenane \\"Fe\\" Nauz", "Skok Trero"]': ['Fenane "Fe" Nauz', "Skok Trero"],
    "Karth, Rezé; Treisk, Skudrin": ["Karth, Rezé", "Treisk, Skudrin"],
    "Fupri, G. O., Feim, Z. & Kreiz, Z.": ["Fupri, G. O.", "Feim, Z.", "Kreiz, Z."],
    '"Sarv, Paré", "Gevé ""Ge"" Deik", "Kestral Network for Genes and Language"': ["Sarv, Paré", 'Gevé "Ge" Deik', "Kestral Network for Genes and Language"],
    '"Ludamo Centre; Data; Models"; Kelvanz Wenane': ["Ludamo Centre; Data; Models", "Kelvanz Wenane"],
    "Tilvanz, Hena, Jr. and Wött, Lavix K.": ["Tilvanz, Hena, Jr.", "Wött, Lavix K."],
    "Lek, Gevane N.||Trol, Pimumi C.": ["Lek, Gevane N.", "Trol, Pimumi C."],
    "Glev SL; Bign LV;Gaut RM | Zeik M, dos Gark SS & Pumb DW": ["Glev SL", "Bign LV", "Gaut RM", "Zeik M", "dos Gark SS", "Pumb DW"],
    "Glop W, Zusk KV, Niro Glip, et al.": ["Glop W", "Zusk KV", "Niro Glip"],
    "Kriproyo Sizeth M": ["Kriproyo Sizeth M"],
    "Geig, Bruma": ["Geig, Bruma"],
    "A One\nB Two": ["A One", "B Two"],
    "Wove Levranz / Krina L. Rark": ["Wove Levranz", "Krina L. Rark"],
    "[]": [],
    " ; ; ": [],
}


@pytest.mark.parametrize("field", CASES)
def test_single_fields(field):
    assert split_field(field) == CASES[field]


def test_nulls_repeats_clashes_and_long_fields(rows):
    many = "; ".join(f"Name{'abcdefghij'[k % 10]} {chr(65 + k % 26)}" for k in range(5000))
    data = [(1, None, "x", 9), (2, "", "x", 9), (3, "Aa B; Aa B", None, 9), (3, "Aa B; Aa B", None, 9), (4, many, "y", 9)]
    df = rows(data, "id long, authors string, src string, pos int")
    got = split_packed(df, "authors", F.col("src"), value="author").collect()
    assert {c for r in got for c in r.asDict()} == {"id", "src", "pos", "author"}
    assert sorted((r["pos"], r["author"]) for r in got if r["id"] == 3) == [(1, "Aa B"), (1, "Aa B"), (2, "Aa B"), (2, "Aa B")]
    assert sorted(r["pos"] for r in got if r["id"] == 4) == list(range(1, 5001))
    assert not [r for r in got if r["id"] in (1, 2)]


def test_empty_table(rows):
    assert split_packed(rows([], "id long, authors string, src string"), "authors", F.col("src")).collect() == []


def test_source_profile_settles_what_a_field_leaves_open(rows):
    from biblioflux.operators.packed_fields import source_profiles

    df = rows([(k, "Aa B; Cc D", "semi") for k in range(5)] + [(9, "Aa B|Cc D", "bar")], "id long, authors string, src string")
    profiles = {r["src"]: r["profile"] for r in source_profiles(df, "authors", F.col("src")).collect()}
    assert max(profiles["semi"], key=profiles["semi"].get) == "semicolon"
    assert max(profiles["bar"], key=profiles["bar"].get) == "bar"


def test_the_source_decides_fields_that_fit_several_ways(rows):
    joint = "Vector Consortium and Atlas Group"
    data = [(k, "Lee Aa and Tan Bb", "and") for k in range(9)] + [(k, "Lee Aa; Tan Bb", "semi") for k in range(9)]
    df = rows([*data, (10, joint, "and"), (11, joint, "semi")], "id long, authors string, src string")
    got = split_packed(df, "authors", F.col("src"), value="author").collect()
    assert [r["author"] for r in sorted((r for r in got if r["id"] == 10), key=lambda r: r["pos"])] == ["Vector Consortium", "Atlas Group"]
    assert [r["author"] for r in got if r["id"] == 11] == [joint]


def test_a_field_leaves_its_source_on_the_evidence_of_its_pieces():
    order = ranking({"comma": 0.9, "semicolon": 0.1})
    assert order[:3] == ["list", "comma", "semicolon"]
    assert split_field("Lee A, Tan B", order) == ["Lee A", "Tan B"]
    assert split_field("Lee, Aa; Tan, Bb", order) == ["Lee, Aa", "Tan, Bb"]
    assert split_field('"Lab; Unit 4"; Tan B', order) == ["Lab; Unit 4", "Tan B"]
