"""Per-document text statistics by Arrow kernels over whole batches, published fixed-threshold rules with a reason per failure, and the form of what fails.

A document that keeps all published rules is prose. The rules don't name forms, so one that fails is looked at line by line: prose in
hard-wrapped or unpunctuated lines stays prose, the rest is a list, a table or junk.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from biblioflux.functions.text import WS, WS_CHARS

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_CELL = re.compile(r"</?t[dhr]\b", re.I)
_ENTITY = re.compile(r"&(?:[a-z]{2,8}|#x?[0-9a-f]+);", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BULLET = re.compile(r"\s*(?:[-–—*•·▪◦‣+o]\s|\(?\d{1,3}[.)\]]\s|\[\d{1,3}\]\s|\(?[a-z]\)\s|[ivx]{1,4}[.)]\s)")
_END = re.compile(r"[.!?。][\"'”’»)\]]*$")
_CODE = re.compile(r"[A-Z]{1,6}\d{1,4}[A-Z]?")
_MOJI = re.compile("[ÃÂâ€ï¿½þÿ¤Ð�™œž]|[\\x80-\\x9f]")
_SEQUENCE = re.compile(r"[ACGTUN]{30,}|\b[ACDEFGHIKLMNPQRSTVWY]{50,}\b")
_LOG = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?|\b0x[0-9a-f]{4,}|\b(?:INFO|WARN|WARNING|ERROR|ERR|DEBUG|TRACE|GET|POST)\b")
_KEYED = re.compile(r'"[^"]{0,40}"\s*:|\bnull\b|[{}]')
_BLOB = re.compile(r"[A-Za-z0-9+/=_\-]{32,}")
_REFERENCE = re.compile(r"(?:\b(?:19|20)\d\d\b\s*[;:,.)]|\bdoi\b|\bet al\b).{0,60}$", re.I)
_AUTHORS = re.compile(r"\s*(?:\[?\d+[\].)]\s*)?[^\W\d_][\w'’\-]+ [A-Z]{1,3}(?:, [^\W\d_][\w'’\- ]+ [A-Z]{1,3})*(?:,? et al)?\. ")
_MENU = re.compile(r"\s*(?:[|·•>»«/]|\s{2,}|\n)\s*")
_WIDE = re.compile(r"\S\s{2,}(?=\S)")
_QUOTED = re.compile(r'"[^"]*"')
_VOWELS = "aeiouyáàâäãåæéèêëíìîïóòôöõøœúùûüýAEIOUYÁÀÂÄÅÆÉÈÊËÍÌÎÏÓÒÔÖØŒÚÙÛÜ"

#: Statistics of every document.
STATS = [
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "letter_word_share", "end_punctuation_share", "bullet_share",
    "short_line_share", "repeated_line_share", "common_words", "common_share", "has_brace",
    "reference_share", "has_cells",
]
#: What a line-by-line look at a document that fails a rule adds.
LAYOUT = [
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "digit_ratio", "vowel_ratio",
    "common_share", "prose_share", "list_share", "table_share", "distinct_share", "repeat_share", "blob_share", "broken_share", "machine_share",
    "menu_share", "packed_ratio",
]
KIND = StructType([StructField(s, LongType() if s.startswith("n_") else DoubleType()) for s in LAYOUT])

# Patterns of the statistics, for both SQL engines.
TAG = r"</?[a-zA-Z][^<>]{0,200}>"
ENTITY = r"&(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]+);"
BREAK = r"[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]+"
ENDING = r"(?:[.!?。…][)\]]*|[”’\x22\x27])$"
BULLET = rf"^(?:[-–—*•·▪◦‣+o][{WS}]|[(]?[0-9]{{1,3}}[.)\]][{WS}]|\[[0-9]{{1,3}}\][{WS}]|[(]?[a-z]\)[{WS}])"
REFERENCE = r"^[^\p{L}]{0,6}\p{L}[\p{L}’\x27-]+ \p{Lu}{1,3}[,.].*\b(?:19|20)[0-9][0-9]\b"
CELL = r"(?i)<t[dh]\b"
SHORT_LINE = 30


def _per_text(lists: pa.ListArray, flags: np.ndarray) -> np.ndarray:
    """Sums of a flag or number per element over each text's list."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    ends = lists.offsets.to_numpy()
    return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _distinct(owners: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct codes per text."""
    pairs = np.unique(owners.astype(np.int64) << 32 | codes.astype(np.int64))
    return np.bincount(pairs >> 32, minlength=n)


def _flags(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(bool)


def statistics(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """STATS of many texts at once, by Arrow kernels over the whole batch; shares are of words or lines, and 0 (mean length too) where
    there are none. Words are runs of characters other than white space, without markup; common words are runs of letters and digits in lower case."""
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    body = texts
    marked = pc.match_substring_regex(texts, "[<&]")
    if pc.any(marked).as_py():
        plain = pc.replace_substring_regex(pc.replace_substring_regex(pc.filter(texts, marked), TAG, " "), ENTITY, " ")
        body = pc.replace_with_mask(texts, marked, plain)
    n_chars = pc.utf8_length(texts).to_numpy()

    # blanks stay as they are, and empty pieces between them count for nothing
    tokens = pc.split_pattern(pc.replace_substring_regex(body, rf"[{WS.replace(r'-\x20', r'-\x1f')}]+", " "), " ")
    token = tokens.flatten()
    size = pc.utf8_length(token).to_numpy()
    n_words = _per_text(tokens, size > 0)
    with_letter = _per_text(tokens, _flags(pc.match_substring_regex(token, r"\p{L}")))

    words = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(body), r"[^\p{L}\p{N} ]+", " "), " ")
    word = words.flatten()
    code = pc.fill_null(pc.index_in(word, value_set=common.cast(pa.large_string())), -1).to_numpy()
    hit = code >= 0
    n_runs = _per_text(words, pc.utf8_length(word).to_numpy() > 0)

    lines = pc.split_pattern(pc.replace_substring_regex(body, BREAK, "\n"), "\n")
    line = pc.utf8_trim(lines.flatten(), characters=WS_CHARS)
    length = pc.utf8_length(line).to_numpy()
    there = length > 0
    n_lines = _per_text(lines, there)
    codes = line.dictionary_encode().indices.to_numpy()

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(n), where=whole > 0)

    def count(mark: str) -> np.ndarray:
        return pc.count_substring(body, mark).to_numpy()

    out = {
        "n_chars": n_chars, "n_words": n_words, "n_lines": n_lines, "mean_word_length": share(_per_text(tokens, size), n_words),
        "symbol_ratio": share(count("#") + count("…") + count("..."), n_words), "letter_word_share": share(with_letter, n_words),
        "end_punctuation_share": share(_per_text(lines, _flags(pc.match_substring_regex(line, ENDING))), n_lines),
        "bullet_share": share(_per_text(lines, _flags(pc.match_substring_regex(line, BULLET))), n_lines),
        "short_line_share": share(_per_text(lines, there & (length < SHORT_LINE)), n_lines),
        "repeated_line_share": share(n_lines - _distinct(_owners(lines)[there], codes[there], n), n_lines),
        "common_words": _distinct(_owners(words)[hit], code[hit], n), "common_share": share(_per_text(words, hit), n_runs),
        "has_brace": _flags(pc.match_substring(body, "{")), "reference_share": share(_per_text(lines, _flags(pc.match_substring_regex(line, REFERENCE))), n_lines),
        "has_cells": _flags(pc.match_substring_regex(texts, CELL)),
    }
    return out


_STATS = StructType([StructField(s, LongType() if s.startswith("n_") or s == "common_words" else BooleanType() if s.startswith("has_") else DoubleType()) for s in STATS])


def with_statistics(df: DataFrame, text: str, common: list[str]) -> DataFrame:
    """``df`` with the columns STATS; only the text passes through Arrow."""

    def measure(texts: pa.Array) -> pa.Array:
        got = statistics(texts, pa.array(common, pa.string()))
        return pa.StructArray.from_arrays([pa.array(got[s]) for s in STATS], STATS)

    udf = F.arrow_udf(measure, _STATS).asNondeterministic()
    keep = [c for c in df.columns if c not in STATS]
    return df.select(*keep, udf(text).alias("__stats")).select(*keep, "__stats.*")


def _cells(line: str) -> int:
    """Number of cells of a row in any layout; 1 for no row."""
    if "\t" in line:
        return line.count("\t") + 1
    if line.count("|") >= 2:
        return line.count("|") + 1
    if "  " in line:
        wide = len(_WIDE.findall(line)) + 1
        if wide >= 3:
            return wide
    for mark in ",;":
        if line.count(mark) >= 2 and f"{mark} " not in (plain := _QUOTED.sub("q", line) if '"' in line else line):
            cells = plain.split(mark)
            if len(cells) >= 3 and all(c.count(" ") <= 5 for c in cells):
                return len(cells)
    return 1


def _line_kind(line: str, words: list[str], known: int) -> str:
    """'table', 'bullet', 'list', 'short', 'bare' or 'prose' for one line, by its layout, its words and the number of common ones among them."""
    tokens = line.split()
    entry = len(tokens) <= 14
    if _BULLET.match(line) and "\t" not in line:
        return "bullet" if entry or _REFERENCE.search(line) else "prose"
    if len(words) >= 5 and known > 0.12 * len(words):
        return "list" if line[:1].isupper() and _AUTHORS.match(line) and _REFERENCE.search(line) else "prose"
    if _cells(line) >= 3:
        return "table"
    if _AUTHORS.match(line) and _REFERENCE.search(line):
        return "list"
    codes = sum(bool(_CODE.fullmatch(t.strip(",;.()"))) for t in tokens)
    if codes >= 3 and codes >= 0.6 * len(tokens):
        return "list"
    if len(tokens) <= 9 and not _END.search(line):
        return "short"
    return "prose" if known else "bare"


def text_layout(text: str, common: frozenset[str]) -> tuple:
    """What the lines of one whole text look like, in the order of LAYOUT; shares are of characters unless they count lines or words.

    The shares of repeats and menu entries are of texts with few common words and the shares of blobs of texts with very long
    words; elsewhere they are 0, and the ratio of
    packed to plain size is 1 where common words aren't few.
    """
    n_chars = len(text)
    tagged = "<" in text
    cell_tags = len(_CELL.findall(text)) if tagged else 0
    body = _TAG.sub(" ", text) if tagged else text
    if "&" in body:
        body = _ENTITY.sub(" ", body)
    tokens = body.split()
    n = max(1, sum(map(len, tokens)))
    digits = sum(map(body.count, "0123456789"))
    lines = [s for s in body.splitlines() if s.strip()]
    sizes: dict[str, int] = {}
    kinds = []
    n_words = letters = known = 0
    for s in lines:
        words = _WORD.findall(s)
        hits = sum(map(common.__contains__, map(str.lower, words)))
        kinds.append(_line_kind(s, words, hits))
        n_words, letters, known = n_words + len(words), letters + sum(map(len, words)), known + hits
    for k, (kind, s) in enumerate(zip(kinds, lines, strict=True)):
        if kind == "short":
            # short lines in a row are entries; a single one is a heading, or the end of a wrapped paragraph
            near = [kinds[j] for j in range(max(0, k - 2), min(len(kinds), k + 3)) if j != k]
            kind = "list" if sum(x in ("short", "list", "bullet") for x in near) >= 2 else "prose"
        sizes[kind] = sizes.get(kind, 0) + len(s)
    if cell_tags >= 6:
        inside = sum(len(_TAG.sub(" ", m)) for m in re.findall(r"<table.*?</table>|<tr.*?</tr>", text, flags=re.S | re.I))
        moved = min(inside, sum(sizes.values()))
        sizes = {"prose": max(0, sum(map(len, lines)) - moved), "table": moved}
    total = max(1, sum(sizes.values()))
    few = known < 0.2 * n_words or n_words < 3
    parts = [p for p in _MENU.split(body) if p.strip()] if few else []
    longest = 0
    if tokens and max(map(len, tokens)) >= 30:
        longest = sum(map(len, _BLOB.findall(body))) + sum(map(len, _SEQUENCE.findall(body)))
    machine = len(_LOG.findall(body)) * 8 if body.count(":") >= 2 or "0x" in body else 0
    machine += len(_KEYED.findall(body)) * 4 if '"' in body or "{" in body or "null" in body else 0
    return (
        n_chars, n_words, len(lines), letters / max(1, n_words), max(0, n - letters - digits) / n, digits / n, sum(map(body.count, _VOWELS)) / max(1, letters),
        known / max(1, n_words), sizes.get("prose", 0) / total, (sizes.get("list", 0) + sizes.get("bullet", 0)) / total, sizes.get("table", 0) / total,
        len(set(tokens)) / max(1, len(tokens)), 1 - len(set(parts)) / max(1, len(parts)) if parts else 0.0, min(1.0, longest / n),
        0.0 if body.isascii() else len(_MOJI.findall(body)) / n, machine / n,
        sum(p.count(" ") <= 3 for p in parts) / len(parts) if len(parts) > 3 else 0.0,
        len(zlib.compress(body.encode(errors="replace"), 1)) / max(1, len(body.encode(errors="replace"))) if few else 1.0,
    )


# Thresholds of published document filters. [G] Rae et al. 2021 (Gopher: quality and repetition), [C] Raffel et al. 2020 (C4; its
# rule on closing punctuation with the 85 % that curation toolkits use), [F] Penedo et al. 2024 (FineWeb).
RULES = {
    "fewer than 50 words [G]": "n_words < 50",
    "more than 100000 words [G]": "n_words > 100000",
    "mean word length outside 3 to 10 [G]": "n_words > 0 AND (mean_word_length < 3 OR mean_word_length > 10)",
    "symbols above a tenth of words [G]": "symbol_ratio > 0.1",
    "fewer than 80 % of words have a letter [G]": "n_words > 0 AND letter_word_share < 0.8",
    "fewer than two common words [G]": "common_words < 2",
    "bullets on more than 90 % of lines [G]": "bullet_share > 0.9",
    "more than 30 % of lines repeat [G]": "repeated_line_share > 0.3",
    "more than 85 % of lines lack closing punctuation [C]": "end_punctuation_share < 0.15",
    "a curly bracket [C]": "has_brace",
    "two thirds of lines are short [F]": "n_lines > 0 AND short_line_share >= 0.67",
    # two rules of our own, for lists and tables that are well punctuated: they are recorded like the others
    "most lines are references [own]": "reference_share >= 0.5",
    "table markup [own]": "has_cells",
}
#: Rules on length alone, which are recorded but tell nothing about the form: a sentence is prose.
OF_LENGTH = {"fewer than 50 words [G]", "more than 100000 words [G]"}
#: Beyond the published rules: what makes a text that fails one of them junk rather than a list or a table.
JUNK = {
    "no words": "n_words = 0 AND n_chars > 0",
    "blobs or sequences": "blob_share > 0.5",
    "broken encoding": "broken_share > 0.12",
    "machine output": "machine_share > 0.25",
    "repeated entries": "repeat_share > 0.5 AND common_share < 0.15 AND n_chars > 60",
    "a menu": "n_lines <= 2 AND menu_share >= 0.8 AND repeat_share >= 0.25 AND common_share < 0.15 AND digit_ratio < 0.1",
    "symbols": "symbol_ratio > 0.45 AND (table_share < 0.5 OR n_words * 20 < n_chars)",
    "repeats itself": "(packed_ratio < 0.1 OR packed_ratio * n_chars < 26) AND n_chars > 100 AND common_share < 0.15",
    "a single row": "n_lines = 1 AND table_share = 1 AND digit_ratio < 0.1 AND common_share < 0.1",
    "repeated tokens": "distinct_share < 0.15 AND common_share < 0.15",
    "no vowels": "vowel_ratio < 0.1 AND list_share < 0.5 OR vowel_ratio < 0.2 AND list_share < 0.5 AND table_share < 0.5",
    "no natural words": "common_share < 0.08 AND mean_word_length > 14",
}


def _reasons(rules: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(e), F.lit(name)) for name, e in rules.items()]))


#: Largest list of common words that is held by every task.
MAX_WORDS = 10_000


def common_words(words: DataFrame, word: str = "word") -> list[str]:
    """The distinct words of a reference list in lower case, at most MAX_WORDS."""
    rows = words.select(F.lower(word).alias("w")).filter("w is not null").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"the list of common words has more than {MAX_WORDS} words")
    return sorted(r["w"] for r in rows)


def text_rules(df: DataFrame, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """``df`` with STATS and ``reasons``, the published rules that the whole text fails; columns of these names are replaced. Null
    and blank texts have no reasons. ``words`` is a reference list of common words (MAX_WORDS at most)."""
    out = with_statistics(df.drop("reasons"), text, common_words(words, word))
    return out.withColumn("reasons", F.when(F.col("n_words") > 0, _reasons(RULES)).otherwise(F.array().cast("array<string>")))


def text_forms(df: DataFrame, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """``df`` without ``text``, with STATS, ``reasons`` (published rules that fail), ``junk_reasons`` and ``form``.

    ``form`` is prose, list, table or junk; for null and blank texts it is null. A text whose reasons are of length alone, or none, is
    prose, and only the others are looked at line by line in Python. Texts are read whole; columns of the names added are replaced;
    an empty table gives an empty table.
    """
    common = frozenset(common_words(words, word))
    added = {*STATS, "reasons", "junk_reasons", "form", "layout"}
    keep = [c for c in df.columns if c != text and c not in added]

    def look(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_layout(t or "", common) for t in texts], columns=LAYOUT)

    udf = F.pandas_udf(look, KIND).asNondeterministic()
    ruled = text_rules(df.select(*keep, F.col(text).alias("__text")), "__text", words, word)
    suspect = F.size(F.array_except("reasons", F.array(*[F.lit(r) for r in sorted(OF_LENGTH)]))) > 0
    ruled = ruled.withColumn("__any", F.col("__text").rlike(r"[^\s\p{Z}\p{Cf}]")).withColumn("__suspect", suspect & F.coalesce("__any", F.lit(False)))
    out = ruled.withColumn("layout", udf(F.when(F.col("__suspect"), F.col("__text"))))
    junk = {name: re.sub(rf"\b({'|'.join(LAYOUT)})\b", r"layout.\1", e) for name, e in JUNK.items()}
    out = out.withColumn("junk_reasons", F.when(F.col("__suspect"), _reasons(junk)).otherwise(F.array().cast("array<string>")))
    form = (
        F.when(~F.coalesce("__any", F.lit(False)), None)
        .when(~F.col("__suspect"), "prose")
        .when(F.size("junk_reasons") > 0, "junk")
        .when(F.expr("layout.prose_share >= 0.5"), "prose")
        .when(F.expr("layout.table_share > 0 AND layout.table_share >= layout.list_share"), "table")
        .when(F.expr("layout.list_share > 0"), "list")
        .otherwise("prose")
    )
    return out.withColumn("form", form).select(*keep, *STATS, "reasons", "junk_reasons", "form")
