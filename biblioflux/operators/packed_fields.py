"""Split fields that pack several values into one string, with the delimiter inferred per source.

Every candidate way of splitting (literal list, strong separators, " and ", commas, comma pairs, a mixture) is scored over all rows
of a source: by the regularity of its pieces' types and the consistency of its piece counts. These scores rank the source's
delimiters, and each field is split by the first of them under which all its pieces are regular: a field departs from its source's
delimiter only on the evidence of its own pieces.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed

CANDIDATES = ["list", "whole", "semicolon", "bar", "line", "tab", "bullet", "slash", "and", "comma", "comma_pairs", "mixed"]
STRONG = {
    "semicolon": re.compile(r";"), "bar": re.compile(r"\|+"), "line": re.compile(r"[\r\n]+"), "tab": re.compile(r"\t"),
    "bullet": re.compile(r"[•·‧∙]"), "slash": re.compile(r"/"),
}
MARKS = {"semicolon": ";", "bar": "|", "line": "\n\r", "tab": "\t", "bullet": "•·‧∙", "slash": "/", "comma": ",", "comma_pairs": ","}

_AND = re.compile(r",?\s+and\s+|\s*&\s*")
_COMMA = re.compile(r",?\s+(?:and|&)\s+|,\s*(?:and\s+|&\s*)?|\s*&\s*")
_MIXED = re.compile(r"[;|•·\t\r\n]+|,\s*(?:and\s+|&\s*)?|\s+and\s+|\s*&\s*")
_SUFFIX = re.compile(r"(?:Jr|Sr|II|III|IV|V)\.?$", re.I)
_ETAL = re.compile(r"[\[(]?(?:et\.?\s*al\.?|and others|u\.\s?a\.)[\])]?\.?$", re.I)
# Words by which a group author is known.
_KW = r"(?:Consortium|Group|Network|Lab|Labs|Laboratory|Centre|Center|Team|Unit|Initiative|Collaboration|Collaborators|Committee|Society|Project|Alliance|Institute|University|Investigators|Association|Program|Programme|Council|Foundation|Atlas)"
_GROUP = re.compile(rf"(?:The\s)?[^,;|&\"]*\b{_KW}\b[^,;|&\"]*$|[^,;|&\"]*\b{_KW}\s(?:on|for|of)\s[^;|\"]*$")
#: A group name with its own comma and conjunction, masked before splitting on commas or conjunctions.
_GROUP_SPAN = re.compile(rf"(?:[^\W\d_]+\s)*{_KW}\s(?:on|for|of)\s[^;|,\"&]+(?:,\s[^;|,\"&]+)*?(?:\s+and\s+|\s*&\s*)[^;|,\"&]+")
_CAP = r"[^\W\d_a-z][\w'’.\-]*"
_SUR = rf"(?:(?:van der|van den|van de|van|von der|von|de la|de|dos|da|di|del|al-|bin|ten|ter|le|la)\s+)*(?:(?:al-|el-|d'|o')?{_CAP})"
_INI = r"(?:[^\W\d_a-z]{1,3}|(?:[^\W\d_a-z]\.[\s\-]?){1,4})"
_SUF = r"(?:,?\s(?:Jr|Sr)\.?|,?\s(?:II|III|IV))?"
_QUOTED = r"(?:\s[\"“'][^\"”]{1,12}[\"”'])?"
TYPES = [
    ("comma_name", re.compile(rf"{_SUR},\s*(?:{_INI}|{_CAP}(?:[\s\-](?:{_CAP}|{_INI}))*){_SUF}$")),
    ("initials", re.compile(rf"{_SUR}\s{_INI}{_SUF}$")),
    ("words", re.compile(rf"{_CAP}{_QUOTED}(?:\s{_INI})?(?:\s{_SUR}){_SUF}$|{_SUR}\s{_CAP}(?:\s{_INI})?{_SUF}$")),
]


def _plain(s: str) -> str:
    """For typing only: compatibility forms folded, invisible characters dropped, white space single."""
    if not s.isascii():
        s = "".join(ch for ch in unicodedata.normalize("NFKC", s) if unicodedata.category(ch) != "Cf")
    return " ".join(s.split())


class Quoted(str):
    """A piece that stood in the packing's quotes: it is one value as it stands, whatever it is made of."""


def piece_type(piece: str) -> str:
    """'comma_name', 'initials', 'words', 'group' (a quoted piece too), or '' for an irregular piece."""
    if isinstance(piece, Quoted):
        return "group"
    if any(ch in piece for ch in "\t\r\n"):
        return ""
    p = _plain(piece)
    if _GROUP.match(p):
        return "group"
    for name, pattern in TYPES:
        if pattern.match(p):
            return name
    return ""


def _unquote(p: str) -> str:
    """Strip white space and one layer of packing quotes; a doubled or escaped inner quote becomes one."""
    p = p.strip()
    if len(p) >= 2 and p[0] == p[-1] == '"':
        inner = p[1:-1].replace('\\"', '"').replace('""', '"').strip()
        return Quoted(inner) if _ONE_QUOTED.fullmatch(p) else inner
    return p


_ONE_QUOTED = re.compile(r'"(?:[^"\\]|""|\\.)*"', re.S)
_QUOTED_ITEM = re.compile(r'(?:^|(?<=[;|,\t\n/•·]))\s*("(?:[^"\\]|""|\\.)*")\s*(?=$|[;|,\t\r\n/•·])')


def _masked(s: str, groups: bool) -> tuple[str, list[str]]:
    """Quoted items (and group names) replaced by private-use marks, so that no separator inside them splits."""
    kept: list[str] = []

    def hide(text: str) -> str:
        kept.append(text)
        return f"{len(kept) - 1}"

    if '"' in s:
        s = _QUOTED_ITEM.sub(lambda m: m[0].replace(m[1], hide(m[1])), s)
    if groups:
        s = _GROUP_SPAN.sub(lambda m: hide(m[0]), s)
    return s, kept


def _shown(p: str, kept: list[str]) -> str:
    return re.sub("(\\d+)", lambda m: kept[int(m[1])], p) if kept else p


def _clean(pieces: list[str], suffixes: bool = True) -> list[str]:
    """Unquoted non-empty pieces; a suffix that stood behind its own comma goes back to its name; a closing et al. goes."""
    out: list[str] = []
    for p in pieces:
        p = _unquote(p)
        bare = _plain(p)
        if not bare or not any(ch.isalnum() for ch in bare):
            continue
        if suffixes and out and _SUFFIX.fullmatch(bare) and len(bare) > 1:
            out[-1] = f"{out[-1]}, {p}"
            continue
        out.append(p)
    if out and _ETAL.fullmatch(_plain(out[-1])):
        out.pop()
    elif out and (m := re.search(r"[,\s]+et\.?\s*al\.?$", out[-1])):
        out[-1] = out[-1][: m.start()].rstrip()
    return out


def _literal(s: str) -> list[str] | None:
    t = s.strip()
    if not (t.startswith("[") and t.endswith("]")):
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            got = parse(t)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(got, list):
            return [str(x) for x in got if x is not None]
    return None


def split_by(s: str, candidate: str) -> list[str] | None:
    """The pieces of a field under one candidate; None where the candidate doesn't apply."""
    if candidate == "list":
        got = _literal(s)
        if got is None:
            return None
        out = [p.strip() for p in got if p.strip()]
        return out[:-1] if out and _ETAL.fullmatch(_plain(out[-1])) else out
    if candidate == "whole":
        return _clean([s])
    if candidate in STRONG:
        if not any(ch in s for ch in MARKS[candidate]):
            return None
        m, kept = _masked(s, False)
        return _clean([_shown(p, kept) for p in STRONG[candidate].split(m)], suffixes=False)
    if candidate == "and":
        if " and " not in s and "&" not in s:
            return None
        m, kept = _masked(s, True)
        return _clean([_shown(p, kept) for p in _AND.split(m)], suffixes=False)
    marks = sum(ch in s for ch in ";|,&")
    if (marks < 2 if candidate == "mixed" else "," not in s):
        return None
    m, kept = _masked(s, True)
    if candidate == "mixed":
        return _clean([_shown(p, kept) for p in _MIXED.split(m)])
    pieces = [_shown(p, kept) for p in _COMMA.split(m)]
    if candidate == "comma":
        return _clean(pieces)
    out, family = [], None
    for p in pieces:
        p, bare = p.strip(), _plain(p)
        if not bare:
            continue
        if family is None:
            if out and _SUFFIX.fullmatch(bare) and len(bare) > 1:
                out[-1] = f"{out[-1]}, {p}"
            elif _GROUP.match(bare) or p.startswith('"') or _ETAL.fullmatch(bare):
                out.append(p)
            else:
                family = p
        else:
            out.append(f"{family}, {p}")
            family = None
    if family is not None:
        out.append(family)
    return _clean(out, suffixes=False)


def score(pieces: list[str]) -> float:
    """Share of regular pieces, less a little for disagreement between their types; groups agree with every type."""
    if not pieces:
        return 0.0
    kinds = [piece_type(p) for p in pieces]
    named = [k for k in kinds if k not in ("", "group")]
    agree = max((named.count(k) for k in set(named)), default=0) / len(named) if named else 1.0
    return (len(pieces) - kinds.count("")) / len(pieces) * (0.85 + 0.15 * agree)


def scores_of(s: str) -> dict[str, tuple[float, list[str]]]:
    """Score and pieces of every candidate that applies; a parsed literal list decides alone."""
    got = split_by(s, "list")
    if got is not None:
        return {"list": (1.0, got)}
    out = {}
    for name in CANDIDATES[1:]:
        pieces = split_by(s, name)
        if pieces is not None:
            out[name] = (score(pieces), pieces)
            if name in STRONG and out[name][0] == 1.0 and len(pieces) > 1:
                break
    return out


def ranking(profile: dict[str, float] | None) -> list[str]:
    """A source's candidates, the best of its profile first; those that it never split by follow in the order of CANDIDATES."""
    profile = profile or {}
    return ["list", *sorted(CANDIDATES[1:], key=lambda k: (-profile.get(k, 0.0), CANDIDATES.index(k)))]


def split_field(s: str | None, order: list[str] = CANDIDATES) -> list[str]:
    """The values of one field by the first candidate of its source's ``order`` whose pieces are all regular; where there is none,
    by the one with the highest share of regular pieces, the earlier one of equals."""
    if s is None or not s.strip():
        return []
    tried = []
    for name in order:
        pieces = split_by(s, name)
        if pieces is None:
            continue
        if name == "list" or pieces and all(map(piece_type, pieces)):
            return pieces
        tried.append(pieces)
    return max(tried, key=lambda pieces: round(score(pieces), 6))


def source_profiles(df: DataFrame, field: str, source: Column) -> DataFrame:
    """(src, n_rows, profile: map candidate -> 0..1) over all rows: the sum of a candidate's scores less by the spread of its piece
    counts, relative to the rows of the source. Batches are summed before the shuffle, so it moves sources x candidates x batches small rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[tuple[str, str], list[float]] = {}
            for src, s in zip(pdf["src"], pdf["val"], strict=True):
                # rows are counted under a name that no candidate has
                sums.setdefault((src, ""), [0, 0.0, 1.0, 0.0])[0] += 1
                if not s.strip():
                    continue
                got = scores_of(s)
                for name, (points, pieces) in got.items():
                    # a field without any separator tells nothing about them
                    if len(pieces) > 1 or len(got) > 1 and name == "whole":
                        acc = sums.setdefault((src, name), [0, 0.0, 0.0, 0.0])
                        n = len(pieces)
                        acc[0], acc[1], acc[2], acc[3] = acc[0] + 1, acc[1] + points, acc[2] + n, acc[3] + n * n
            if sums:
                yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["src", "cand", "n", "points", "pieces", "squares"]).astype({"n": "int64"})

    rows = df.select(F.coalesce(source, F.lit("")).alias("src"), F.col(field).alias("val")).filter(F.length("val") > 0)
    sums = rows.mapInPandas(partial, "src string, cand string, n long, points double, pieces double, squares double")
    total = sums.groupBy("src", "cand").agg(*[F.sum(c).alias(c) for c in ("n", "points", "pieces", "squares")])
    mean = F.col("pieces") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))) / mean
    scored = total.withColumn("w", F.col("points") / (F.lit(1.0) + spread))
    named = F.when(F.col("cand") != "", F.struct("cand", "w"))
    n_rows = F.max(F.when(F.col("cand") == "", F.col("n"))).alias("n_rows")
    summed = scored.groupBy("src").agg(n_rows, F.map_from_entries(F.collect_list(named)).alias("profile"))
    return summed.withColumn("profile", F.transform_values("profile", lambda _, w: w / F.col("n_rows")))


def split_packed(df: DataFrame, field: str, source: Column, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per value of ``field``: the columns of ``df`` other than ``field``, then ``pos`` (from 1) and ``value``.

    Null, blank and empty-list fields give no rows; repeated values keep their positions; the field is processed whole whatever
    its length. ``pos`` and ``value`` replace columns of those names. An empty table gives an empty table.
    """

    orders: dict[str, list[str]] = {}

    def pieces(vals: pd.Series, sources: pd.Series, profiles: pd.Series) -> pd.Series:
        out = []
        for v, src, p in zip(vals, sources, profiles, strict=True):
            if src not in orders:
                if len(orders) > 100_000:
                    orders.clear()
                orders[src] = ranking(dict(p) if p is not None else None)
            out.append(split_field(v, orders[src]))
        return pd.Series(out)

    # as nondeterministic it is evaluated once, and not again for the filter that an explode brings along
    pieces = F.pandas_udf(pieces, ArrayType(StringType())).asNondeterministic()
    profiles = source_profiles(df, field, source).select(F.col("src").alias("__src"), F.col("n_rows").alias("__n"), F.col("profile").alias("__profile"))
    keep = [c for c in df.columns if c not in (field, value, pos)]
    rows = df.select(*keep, F.col(field).alias("__val"), F.coalesce(source, F.lit("")).alias("__src")).filter(F.length("__val") > 0)
    joined = join_aggregate(rows, checkpointed(profiles), ["__src"], "__n")
    split = joined.select(*keep, pieces("__val", "__src", "__profile").alias("__pieces"))
    return split.select(*keep, F.posexplode("__pieces").alias(pos, value)).withColumn(pos, (F.col(pos) + 1).cast("long"))
