"""Boolean search in seven provider dialects: one expression tree per query, compiled to a Column.

Local meaning: a term or phrase matches in any case as whole words, blanks and hyphens between its words being equal; a trailing
``*`` matches any ending. Ranking and stemming of the providers aren't reproduced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A word or phrase in the named fields; () stands for the default text fields."""

    text: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Range:
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Facet:
    field: str
    value: str


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


#: Field names of each dialect -> field groups of the compiler.
PUBMED_FIELDS = {"title/abstract": ("title", "abstract"), "title": ("title",), "abstract": ("abstract",)}
PREFIX_FIELDS = {"ti": ("title",), "abs": ("abstract",), "all": ("title", "abstract")}
FACET_FIELDS = {"cat": "category", "src": "source", "lang": "language", "language": "language", "openaccess": "open_access", "sb": "subset"}

_TOKEN = re.compile(
    r"""\s*(?:(?P<range>[A-Za-z_]+:\[\s*\S+\s+TO\s+\S+\s*\])|(?P<date>date(?:from|to):\S+)|(?P<year>PUBYEAR\s*[<>=]+\s*\d{4})
    |(?P<func>(?!(?:AND|OR|NOT|ANDNOT)\()[A-Z][A-Z-]+\()|(?P<quoted>(?:[A-Za-z_]+:)?"[^"]*"(?:\[[^\]]*\])?)|(?P<paren>[()])|(?P<op>[+|](?=[\s("\w])|-(?=[("]|\w)(?<![\w]-))
    |(?P<colon>:)|(?P<word>[^\s()"|+\[\]]+(?:\[[^\]]*\])?))""",
    re.X,
)


class _Parser:
    def __init__(self, text: str, dialect: str) -> None:
        self.dialect = dialect
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"can't read the query from {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.k = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.k] if self.k < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.k += 1
        return token

    def is_op(self, *names: str) -> bool:
        kind, s = self.peek()
        return (kind == "word" and s in names) or (kind == "op" and s in names)

    def either(self):
        items = [self.both()]
        while self.is_op("OR", "|"):
            self.next()
            items.append(self.both())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def both(self):
        items = [self.single()]
        while True:
            if self.is_op("AND", "+"):
                self.next()
                items.append(self.single())
            elif self.is_op("ANDNOT", "NOT", "-"):
                self.next()
                items.append(Not(self.single()))
            elif self.peek()[0] != "end" and self.peek()[1] != ")" and not self.is_op("OR", "|"):
                items.append(self.single())  # side by side means AND
            else:
                return items[0] if len(items) == 1 else And(tuple(items))

    def single(self):
        kind, s = self.next()
        if kind == "op" and s == "-" or kind == "word" and s == "NOT":
            return Not(self.single())
        if kind == "paren" and s == "(":
            inner = self.either()
            self.close()
            return inner
        if kind == "func":
            return self.function(s[:-1])
        if kind == "range":
            field, low, high = re.fullmatch(r"(\w+):\[\s*(\S+)\s+TO\s+(\S+)\s*\]", s).groups()
            return Range("date", _dashed(low), _dashed(high))
        if kind == "date":
            side, value = s.split(":", 1)
            return Range("date", value, "9999") if side == "datefrom" else Range("date", "0000", value)
        if kind == "year":
            sign, value = re.fullmatch(r"PUBYEAR\s*([<>=]+)\s*(\d{4})", s).groups()
            y = int(value)
            spans = {">": (str(y + 1), "9999"), ">=": (value, "9999"), "<": ("0000", str(y - 1)), "<=": ("0000", value), "=": (value, value)}
            if sign not in spans:
                raise ValueError(f"unknown comparison {sign}")
            return Range("year", *spans[sign])
        if kind in ("quoted", "word"):
            return self.leaf(s)
        raise ValueError(f"unexpected {s!r}")

    def close(self) -> None:
        if self.next()[1] != ")":
            raise ValueError("a bracket isn't closed")

    def function(self, name: str):
        if name in ("OPENACCESS", "LANGUAGE"):
            value = self.next()[1].strip('"')
            self.close()
            return Facet(FACET_FIELDS[name.lower()], value)
        if name == "LIMIT-TO":
            field, value = self.next()[1].rstrip(","), self.next()[1].strip(',"')
            self.close()
            return Facet(field.lower(), value)
        inner = self.either()
        self.close()
        fields = {"TITLE-ABS-KEY": ("title", "abstract", "keywords"), "TITLE": ("title",), "ABS": ("abstract",)}.get(name)
        if fields is None:
            raise ValueError(f"unknown function {name}")
        return _scoped(inner, fields)

    def leaf(self, s: str):
        prefix = re.match(r"([A-Za-z_]+):(?=.)", s)
        if prefix and (name := prefix[1].lower()) in PREFIX_FIELDS:
            return Term(s[prefix.end() :].strip('"'), PREFIX_FIELDS[name])
        if prefix and name in FACET_FIELDS:
            return Facet(FACET_FIELDS[name], s[prefix.end() :].strip('"'))
        suffix = re.search(r"\[([^\]]*)\]$", s)
        if suffix:
            name, text = suffix[1].lower(), s[: suffix.start()].strip('"')
            if name.startswith("date"):
                if self.peek()[0] == "colon":
                    self.next()
                    high = re.sub(r"\[.*$", "", self.next()[1]).strip('"')
                    return Range("date", _dashed(text), _dashed(high))
                return Range("date", _dashed(text), _dashed(text))
            if name in FACET_FIELDS:
                return Facet(FACET_FIELDS[name], text)
            return Term(text, PUBMED_FIELDS.get(name, ()))
        return Term(s.strip('"'))


def _dashed(s: str) -> str:
    s = s.replace("/", "-")
    return f"{s[:4]}-{s[4:6]}-{s[6:]}" if re.fullmatch(r"\d{8}", s) else s


def _scoped(node, fields: tuple[str, ...]):
    if isinstance(node, Term):
        return node if node.fields else Term(node.text, fields)
    if isinstance(node, Not):
        return Not(_scoped(node.item, fields))
    if isinstance(node, And | Or):
        return type(node)(tuple(_scoped(x, fields) for x in node.items))
    return node


DIALECTS = ("pubmed", "scopus", "semantic_scholar", "arxiv", "europepmc", "springernature", "google_scholar")


def parse(query: str, dialect: str):
    """The expression tree of a query; AND binds closer than OR, terms side by side are joined by AND."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    parser = _Parser(query, dialect)
    tree = parser.either()
    if parser.peek()[0] != "end":
        raise ValueError(f"unexpected {parser.peek()[1]!r}")
    return tree


def term_pattern(text: str) -> str:
    """A Java pattern for a term: whole words in any case, blanks and hyphens equal, a trailing * open-ended."""
    open_end = text.endswith("*")
    words = [re.sub(r"([^\w])", r"\\\1", w) for w in re.split(r"[\s\-]+", text.rstrip("*")) if w]
    return r"(?iu)(?<![\p{L}\p{N}])" + r"[\s\-]+".join(words) + ("" if open_end else r"(?![\p{L}\p{N}])")


def _compile(tree, columns: dict[str, Column], default: tuple[str, ...]) -> Column:
    """Like compile_query, but null where the answer hangs on facets and ranges that have no column."""
    unknown = F.lit(None).cast("boolean")
    if isinstance(tree, Term):
        hits = [F.coalesce(columns[f].rlike(term_pattern(tree.text)), F.lit(False)) for f in (tree.fields or default) if f in columns]
        return reduce(lambda a, b: a | b, hits, F.lit(False))
    if isinstance(tree, Range):
        if tree.field not in columns:
            return unknown
        c = columns[tree.field].cast("string")
        return F.coalesce((c >= tree.low) & (F.left(c, F.lit(len(tree.high))) <= tree.high), F.lit(False))
    if isinstance(tree, Facet):
        return F.coalesce(F.lower(columns[tree.field]) == tree.value.lower(), F.lit(False)) if tree.field in columns else unknown
    if isinstance(tree, Not):
        return ~_compile(tree.item, columns, default)
    parts = [_compile(x, columns, default) for x in tree.items]
    return reduce(lambda a, b: a & b, parts) if isinstance(tree, And) else reduce(lambda a, b: a | b, parts)


def compile_query(tree, columns: dict[str, Column], default: tuple[str, ...] = ("title", "abstract")) -> Column:
    """A boolean Column for a tree. ``columns`` maps field names to columns; fields without one match nothing as text, and what a facet
    or range without one would decide, under NOT too, is taken to hold (the provider has applied it). Null text matches nothing."""
    return F.coalesce(_compile(tree, columns, default), F.lit(True))


def search(query: str, dialect: str, columns: dict[str, Column], default: tuple[str, ...] = ("title", "abstract")) -> Column:
    return compile_query(parse(query, dialect), columns, default)
