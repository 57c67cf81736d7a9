"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from biblioflux.functions.identifiers import PLACEHOLDERS
from biblioflux.functions.text import WS
from biblioflux.llm.components import BARE_HEADINGS
from biblioflux.llm.text_quality import BREAK, BULLET, CELL, ENDING, ENTITY, REFERENCE, RULES, SHORT_LINE, STATS, TAG

_GAP = r"[\s\p{Z}\p{Cf}]+"
_EDGE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _missing(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{_EDGE}|{_EDGE}$', '', 'g')) in ({_listed(PLACEHOLDERS)})"


def _tight(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '{_GAP}', '', 'g')"


def _doi(x: str) -> str:
    decoded = f"regexp_replace(lower(url_decode(replace({_tight(x)}, '+', '%2B'))), '{_GAP}', '', 'g')"
    body = rf"regexp_extract({decoded}, '(10\.\d{{4,9}}(?:\.\d+)*/[^?#]+)', 1)"
    return rf"nullif(regexp_replace({body}, '[.,;:!/)\]}}>\x{{22}}\x{{27}}”’]+$', ''), '')"


def _plain(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


_LOOKS = r"(?i)^\W*(?:(?:https?://|doi\b|www\.)\S*?\s*:?\s*)?10\.\d{4,9}\s*(?:/|%2F)\s*\S+\s*$"

P2_FOUND = rf"""with s as (select cluster_id, regexp_matches(coalesce(title, ''), '{_LOOKS}') and not regexp_matches(coalesce(doi, ''), '{_LOOKS}') as exchanged, coalesce(title, '') as t, coalesce(doi, '') as d from deduplicated_records),
f as (select cluster_id, case when exchanged then d else t end as work, case when exchanged then t else d end as number from s),
k as (select cluster_id, case when {_missing("work")} then '' else {_plain("work")} end as name, case when {_missing("number")} then '' else coalesce({_doi("number")}, {_plain("number")}) end as ident from f),
g as (select cluster_id, min(cluster_id) over (partition by name, ident) as first_id from k where name <> '')
select first_id, cluster_id as copy_id from g where cluster_id <> first_id"""

_PMID = rf"nullif(regexp_extract({_tight('pmid')}, '^(?:https?://[^0-9]*/)?(?:pubmed|pmid)?(?:id)?[:#/]*0*([1-9]\d*)(?:\.0*)?/?$', 1), '')"
_ARXIV = rf"nullif(regexp_extract({_tight('arxiv_id')}, '(?:^|[:/])(\d{{4}}\.\d{{4,6}}|[a-z][a-z.\-]*/\d{{7}})(?:v\d+)?(?:\.pdf)?/?(?:[?#].*)?$', 1), '')"
_BARE = f"lower(regexp_replace(title_normalized, '^{_EDGE}|{_EDGE}$', '', 'g')) in ({_listed(BARE_HEADINGS)})"

P6_FOUND = f"""with recursive k as (select cluster_id, 'doi' as kind, {_doi("doi")} as key from deduplicated_records union all select cluster_id, 'pmid', {_PMID} from deduplicated_records
 union all select cluster_id, 'arxiv', {_ARXIV} from deduplicated_records
 union all select cluster_id, 'title', case when not {_missing("title_normalized")} and not {_BARE} then title_normalized end from deduplicated_records),
h as (select cluster_id, min(cluster_id) over (partition by kind, key) as hub from k where key is not null),
e as (select cluster_id as a, hub as b from h where cluster_id <> hub union select hub, cluster_id from h where cluster_id <> hub),
r(node, seen) as (select a, a from e union select r.node, e.b from r join e on e.a = r.seen)
select node as cluster_id, min(seen) as group_id from r group by 1"""


def _share(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then ({part}) / {whole} else 0 end"


def _lines(test: str) -> str:
    return _share(f"len(list_filter(lines, lambda x: {test}))", "len(lines)")


def _count(mark: str) -> str:
    return f"(length(body) - length(replace(body, '{mark}', ''))) / {len(mark)}"


_WS_DUCK = WS.replace("-\\x20", "-\\x{20}")
_STATS = {
    "n_chars": "length(coalesce(text, ''))", "n_words": "len(tokens)", "n_lines": "len(lines)", "mean_word_length": _share("length(coalesce(array_to_string(tokens, ''), ''))", "len(tokens)"),
    "symbol_ratio": _share(" + ".join(map(_count, ("#", "…", "..."))), "len(tokens)"), "letter_word_share": _share(r"len(list_filter(tokens, lambda x: regexp_matches(x, '\p{L}')))", "len(tokens)"),
    "end_punctuation_share": _lines(f"regexp_matches(x, '{ENDING}')"), "bullet_share": _lines(f"regexp_matches(x, '{BULLET}')"), "short_line_share": _lines(f"length(x) < {SHORT_LINE}"),
    "repeated_line_share": _share("len(lines) - len(list_distinct(lines))", "len(lines)"), "common_words": "len(list_distinct(list_filter(words, lambda x: list_contains(known, x))))",
    "common_share": _share("len(list_filter(words, lambda x: list_contains(known, x)))", "len(words)"), "has_brace": "contains(body, '{')",
    "reference_share": _lines(f"regexp_matches(x, '{REFERENCE}')"), "has_cells": f"regexp_matches(coalesce(text, ''), '{CELL}')",
}
_BODY = f"regexp_replace(regexp_replace(coalesce(text, ''), '{TAG}', ' ', 'g'), '{ENTITY}', ' ', 'g')"
_REASONS = ", ".join(f"case when {e} then '{r}' end" for r, e in RULES.items())
_ROUNDED = ", ".join(f"round({s}, 6) as {s}" if s.endswith(("_share", "_ratio", "_length")) else s for s in STATS)
P9_STATS = rf"""with b as (select doc_id, text, {_BODY} as body, (select list(distinct lower(word)) from common_words) as known from documents),
l as (select *, list_filter(regexp_split_to_array(body, '[{_WS_DUCK}]+'), lambda x: x <> '') as tokens, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as words,
 list_filter(list_transform(regexp_split_to_array(body, '{BREAK}'), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> '') as lines from b),
s as (select doc_id, {", ".join(f"{e} as {n}" for n, e in _STATS.items())} from l)
select doc_id, {_ROUNDED}, case when n_words > 0 then array_to_string(list_filter([{_REASONS}], lambda x: x is not null), '; ') else '' end as reasons from s"""
