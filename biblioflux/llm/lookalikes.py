"""Visually identical text with different characters: look-alike classes, frequent representatives, greedy rewriting."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Letters of other alphabets that look like a Latin one. Greek letters that are used as symbols aren't among them.
POSING = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "Ϲ": "C", "ϲ": "c", "ϳ": "j",
    "Ѵ": "V", "ѵ": "v", "Ӏ": "I", "ӏ": "l", "Ү": "Y", "ү": "y", "Ԛ": "Q", "Ԝ": "W",
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "Տ": "S", "հ": "h", "ո": "n", "ց": "g",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Read without Latin letters beside them in their word, these are taken for symbols.
ONLY_IN_WORDS = set("ν")
INVISIBLE = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and not 0xE0000 <= c] + [chr(c) for c in range(0xFE00, 0xFE10)] + ["͏"]
SPACES = [chr(c) for c in range(0x3001) if unicodedata.category(chr(c)) == "Zs" and c != 0x20]
WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)]
#: Forms of Latin letters and digits for mathematics, Roman numerals and ligatures, by their compatibility decompositions.
STYLED = [chr(c) for r in ((0x1D400, 0x1D800), (0x2160, 0x2180), (0xFB00, 0xFB07)) for c in range(*r) if unicodedata.normalize("NFKC", chr(c)).isascii()]
#: What a text must hold for a rewrite to be possible, as a Java pattern: everything rewritten lies above Latin letters but for two.
SUSPECT = r"[\xa0\xad\x{250}-\x{10ffff}]"
_SEGMENT = re.compile(r"[;|\t\r\n,/•·]+")
_WORD = re.compile(r"[^\W\d_]+")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def join(self, a: str, b: str) -> None:
        self.up[self.root(a)] = self.root(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.up:
            out.setdefault(self.root(s), []).append(s)
        return out


def lookalike_classes() -> dict[str, list[str]]:
    """Transitive classes by root, from rules: wide forms, invisible characters, spaces, posing letters, composed accents.

    An accent on any member of a letter's class falls into the class of the accented letter, so that chains such as a Cyrillic
    letter with a combining accent and the composed Latin letter are closed.
    """
    c = Classes()
    for ch in WIDE + STYLED:
        c.join(ch, unicodedata.normalize("NFKC", ch))
    for ch in INVISIBLE:
        c.join(ch, "")
    for ch in SPACES:
        c.join(ch, " ")
    for ch, latin in POSING.items():
        c.join(ch, latin)
    like = {m: ms for ms in c.members().values() for m in ms}
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and unicodedata.category(ch)[0] == "L":
            for base in like.get(parts[0], [parts[0]]):
                c.join(base + parts[1:], ch)
            if len(parts) == 3:
                inner = unicodedata.normalize("NFC", parts[:2])
                c.join(inner + parts[2], ch)
                c.join(unicodedata.normalize("NFC", parts[0] + parts[2]) + parts[1], ch)
    for code in range(0xC0, 0x2000):  # composed letters on a posing base (such as Cyrillic o with diaeresis)
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0] in POSING:
            c.join(chr(code), POSING[parts[0]] + parts[1])
    return {r: sorted(ms) for r, ms in c.members().items() if len(ms) > 1}


def class_counts(df: DataFrame, fields: list[str]) -> dict[str, int]:
    """Occurrences in the whole corpus of every member of a class; at most one row per member reaches the driver."""
    members = {m for ms in lookalike_classes().values() for m in ms}
    spelled = [m for m in members if len(m) > 1 and m.isascii()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for pdf in batches:
            for f in fields:
                text = "\n".join(pdf[f].dropna())
                n.update(text)
                for m in spelled:
                    n[m] += text.count(m)
                for seq in re.findall("[^\\W\\d_][̀-ͯ]+", text):
                    n[seq] += 1
        rows = [(k, v) for k, v in n.items() if k in members]
        yield pd.DataFrame(rows, columns=["member", "n"]).astype({"n": "int64"})

    return {r["member"]: r["n"] for r in df.select(*fields).mapInPandas(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()}


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """member -> its class's most frequent member, for all others; the empty text represents what is invisible. Ties go to the
    shortest member, then the smallest code point."""
    out = {}
    for ms in lookalike_classes().values():
        best = "" if "" in ms else min(ms, key=lambda m: (-counts.get(m, 0), len(m), m))
        out |= {m: best for m in ms if m != best}
    return out


def _script(ch: str) -> str:
    if ch.isascii():
        return "L"
    c = ord(ch)
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "G"
    if 0x400 <= c < 0x530 or 0x2DE0 <= c < 0x2E00 or 0xA640 <= c < 0xA6A0:
        return "C"
    if 0x530 <= c < 0x590 or 0x13A0 <= c < 0x1400:  # Armenian, Cherokee
        return "A"
    return "L" if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0xFF21 <= c < 0xFF5B else "O"


class Rewriter:
    """Greedy leftmost-longest rewriting with one automaton over all members that aren't representatives."""

    def __init__(self, rep: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for m, r in rep.items():
            self.automaton.add_word(m, (m, r))
        self.automaton.make_automaton()
        self.invisible = re.compile("[" + "".join(INVISIBLE) + "]")

    def posing_spots(self, text: str) -> set[int]:
        """Positions of letters of another alphabet that stand in a word with Latin letters, or in a word made of look-alikes only
        beside Latin words of the same segment (names are segments); names wholly in another alphabet and symbols aren't."""
        spots: set[int] = set()
        start = 0
        for end in [*(m.start() for m in _SEGMENT.finditer(text)), len(text)]:
            segment = text[start:end]
            seen, where = [], []
            for i, ch in enumerate(segment):
                if not self.invisible.match(ch) and unicodedata.category(ch) != "Mn":
                    seen.append(ch)
                    where.append(start + i)
            plain = "".join(seen)
            latin = any(ch.isalpha() and _script(ch) == "L" for ch in plain)
            for w in _WORD.finditer(plain) if latin else ():
                kinds = [_script(ch) for ch in w[0]]
                foreign = [k for k, s in enumerate(kinds) if s in "GCA"]
                if not foreign:
                    continue
                mixed = "L" in kinds
                base = [unicodedata.normalize("NFD", w[0][k])[0] for k in foreign]
                if mixed or (len(foreign) == len(kinds) and all(b in POSING and b not in ONLY_IN_WORDS for b in base)):
                    spots |= {where[w.start() + k] for k, b in zip(foreign, base, strict=True) if b in POSING}
            start = end + 1
        return spots

    def rewrite(self, text: str) -> str:
        out, at = [], 0
        spots: set[int] | None = None
        for end, (m, r) in self.automaton.iter_long(text):
            begin = end - len(m) + 1
            if m and _script(m[0]) in "GCA" and unicodedata.normalize("NFD", m)[0] in POSING and not (r and _script(r[0]) == _script(m[0])):
                spots = self.posing_spots(text) if spots is None else spots
                if begin not in spots:
                    continue
            out += [text[at:begin], r]
            at = end + 1
        return "".join(out) + text[at:] if out else text


def consistent(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with ``fields`` rewritten, and ``changed``, the array of the fields that were in another form before.

    A field also counts as changed if it keeps a combining accent for which there is no composed letter. Null and empty fields stay
    as they are; texts are processed whole; columns of other names are untouched (``changed`` is replaced). Only rows with a
    suspect character pass through Python.
    """
    rep = representatives(class_counts(df, fields))
    shared = df.sparkSession.sparkContext.broadcast(rep)
    made: list[Rewriter] = []

    def rewrite(values: pd.Series) -> pd.Series:
        if not made:
            made.append(Rewriter(shared.value))
        return pd.Series([[made[0].rewrite(v) if v and not v.isascii() else v for v in row] for row in values])

    new = F.pandas_udf(rewrite, ArrayType(StringType())).asNondeterministic()
    suspect = F.lit(False)
    for f in fields:
        suspect = suspect | F.coalesce(F.col(f).rlike(SUSPECT), F.lit(False))
    rest = [c for c in df.columns if c not in fields and c != "changed"]
    odd = df.filter(suspect).withColumn("__new", new(F.array(*fields)))
    differs = [F.when(~F.col(f).eqNullSafe(F.col("__new")[i]) | F.col(f).rlike(r"[\x{300}-\x{36f}]"), F.lit(f)) for i, f in enumerate(fields)]
    odd = odd.select(*rest, *[F.col("__new")[i].alias(f) for i, f in enumerate(fields)], F.array_compact(F.array(*differs)).alias("changed"))
    plain = df.filter(~suspect).select(*rest, *fields, F.array().cast("array<string>").alias("changed"))
    return odd.unionByName(plain)

