"""Text cut off by field limits: word trigrams inside sentences against trigrams at sentence ends, in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflux.functions.text import WS
from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed

# Fields that only say that there is no text.
NO_TEXT = r"(?is)^\W*(?:no\s+)?(?:abstract|summary|n/?a|null|none|nan|nil|unknown|missing|tbd|undefined|not\s+available|unavailable)?\s*(?:is\s+|was\s+)?(?:not\s+)?(?:available|provided|supplied|given|found|present)?\W*$"
# Marks that are put after a cut.
_WORD_OF_CUT = r"(?:…|\.{2,}|(?:text|abstract)?\s*(?:truncated|shortened|cut|omitted)(?: off)?|(?:read )?more|continued|cont\.?)"
CUT_MARK = rf"(?is)(?:…|\.{{3,}}|\[\s*{_WORD_OF_CUT}\s*\]|\(\s*{_WORD_OF_CUT}\s*\)|\b(?:read|see|show) more\s*[.>»→]*|(?<=\w)--|\s(?:-->|>>|»|→)|\s)+$"
TERMINATED = r"""[.!?。！？][\s"'”’»)\]]*$"""
#: Endings that are whole without a full stop: an address, a keyword list, a closed bracketed remark.
ADDRESS = r"(?is)(?:https?://|www\.|doi:\s?)\S+\s*$"
KEYWORDS = r"(?is)(?:^|[.!?\s])(?:key\s?words?|index terms?|subject terms?|mesh terms?|schl[üu]sselw[öo]rter|mots[- ]cl[ée]s|palabras clave)\s*[:—–-][^.!?]*$"
BRACKETED = r"(?s)[.!?]\s*[(\[][^()\[\]]*[)\]]\s*$"
OPEN_TAG = r"(?is)<(?:cut|truncated|more|snip)/?>\s*$|(?:<|&lt;?|&amp;lt;?)/?(?:[a-zA-Z!][^<>]{0,80})?$"
OPEN_ENTITY = r"(?:&amp|&)(?:#[xX]?[0-9a-fA-F]{0,6}|[a-zA-Z]{0,8}|;#?[a-zA-Z0-9]{0,8})$"

#: An ending counts as a sentence end if at least this share of its trigram's occurrences is at one. It may be low: a cut seldom falls
#: on the very word where a sentence could have ended. Endings known by fewer words or by a class only need more.
LEAST_END_SHARE = 0.05
LEAST_SHORT_SHARE = 0.30
#: A terminated text as cut if its ending has this many occurrences inside and at most LOW_SHARE at an end.
LEAST_INSIDE = 30
LOW_SHARE = 0.01


#: SQL: a text with single blanks between words and one before the first; a pattern is applied only where it can change something.
SPACED = "concat(' ', replace(replace(replace(replace(TEXT, :nl, ' '), :cr, ' '), :tab, ' '), :nbsp, ' '))"
#: SQL: words in lower case; those with figures or inner capitals become the class '#', with their closing punctuation kept.
WORDS = "split(ltrim(lower(regexp_replace(CASE WHEN contains(TEXT, '  ') THEN regexp_replace(TEXT, ' +', ' ') ELSE TEXT END, :mask, ' #'))), ' ')"
#: SQL: a word's hash without outer punctuation, its lowest bit telling whether a sentence ends behind it.
_ENDS = " OR ".join(f"endswith(w, '{x}')" for x in ".!?。")
_CLOSES = " OR ".join(f"endswith(w, '{x}')" for x in ')"”’»]')
STOPS = f"({_ENDS} OR ({_CLOSES}) AND right(rtrim(:closing, w), 1) IN ('.', '!', '?', '。'))"
HASHES = f"transform({WORDS}, w -> (xxhash64(trim(BOTH :outer FROM w)) & -2) | CASE WHEN {STOPS} THEN 1 ELSE 0 END)"

#: LATERAL VIEW explode(array(x)) evaluates x once a row; a plain column would be computed again for every use of it.
TIDY = """
base AS (
  SELECT $id AS id, $source AS src, trim(BOTH :blank FROM $text) AS raw FROM {df}
), tidy AS (
  SELECT id, src, raw, raw IS NULL OR NOT raw RLIKE :letter OR (length(raw) < 200 AND raw RLIKE :no_text) AS empty, t.body
  FROM base LATERAL VIEW explode(array(rtrim(:blank, CASE
    WHEN contains(raw, '<') THEN regexp_replace(regexp_replace(raw, :tag, ' '), :entity, ' ')
    WHEN contains(raw, '&') THEN regexp_replace(raw, :entity, ' ') ELSE raw END))) t AS body
), heads AS (
  SELECT id, src, raw, empty, body, t.head FROM tidy LATERAL VIEW explode(array(
    CASE WHEN right(body, 40) RLIKE :cut_mark THEN rtrim(:blank, regexp_replace(body, :cut_mark, '')) ELSE body END)) t AS head
)"""

#: Each trigram (by hash, beside the hash of its last word) inside sentences and at their ends. The last trigram of a text without a
#: full stop counts for neither.
COUNT = f"""
WITH {TIDY}, words AS (
  SELECT t.w FROM (SELECT e.line FROM heads LATERAL VIEW explode(array({SPACED.replace("TEXT", "head")})) e AS line WHERE NOT empty)
  LATERAL VIEW explode(array({HASHES.replace("TEXT", "line")})) t AS w
)
SELECT h3, first(h1 & -2) AS h1, count_if(h1 & 1 = 1) AS ends, count_if(h1 & 1 = 0) AS inside
FROM (SELECT xxhash64(a, b, h1 & -2) AS h3, h1
      FROM (SELECT inline(arrays_zip(slice(w, 1, n), slice(w, 2, n), slice(w, 3, n))) AS (a, b, h1)
            FROM (SELECT w, size(w) - 3 + CAST(try_element_at(w, -1) & 1 AS INT) AS n FROM words WHERE size(w) > 3)))
GROUP BY h3
"""

#: The verdict where the text alone decides (null where its final trigram has to), so that no text is shuffled.
JUDGE = f"""
WITH {TIDY}, ends AS (
  SELECT id, src, CASE
      WHEN empty THEN false
      WHEN raw RLIKE :open_tag OR raw RLIKE :open_entity THEN true
      WHEN body <> head THEN true
      WHEN right(head, 40) RLIKE :terminated THEN NULL
      WHEN body RLIKE :address OR body RLIKE :keywords OR body RLIKE :bracketed THEN false END AS verdict,
    coalesce(right(head, 40) RLIKE :terminated, false) AS stopped, CASE WHEN NOT empty THEN {SPACED.replace("TEXT", "substring_index(head, ' ', -3)")} END AS tail
  FROM heads
)
-- the last three words, however long they are
SELECT id, src, verdict, stopped, coalesce(h[size(h) - 1] & -2 = xxhash64('#') & -2, false) AS classed, coalesce(try_element_at(h, -1) & -2, 0) AS k1,
       CASE WHEN size(h) > 2 THEN xxhash64(h[size(h) - 3], h[size(h) - 2], h[size(h) - 1] & -2) ELSE 0 END AS k3
FROM ends LATERAL VIEW explode(array({HASHES.replace("TEXT", "tail")})) t AS h
"""

#: The verdict of every distinct ending, with the number of texts that ask for it.
ENDINGS = f"""
WITH asks AS (
  SELECT stopped, classed, k1, k3, count(*) AS n FROM {{asked}} WHERE verdict IS NULL GROUP BY stopped, classed, k1, k3
), singles AS (
  SELECT h1, sum(ends) AS ends, sum(inside) AS inside FROM {{grams}} GROUP BY h1
), judged AS (
  SELECT a.*, g.ends AS e3, g.inside AS i3,
         CASE WHEN g.ends + g.inside >= 3 THEN g.ends / (g.ends + g.inside)
              WHEN s.ends + s.inside >= 3 THEN s.ends / (s.ends + s.inside) ELSE 0 END AS share,
         CASE WHEN g.ends + g.inside >= 3 AND NOT classed THEN {LEAST_END_SHARE} ELSE {LEAST_SHORT_SHARE} END AS least
  FROM asks a LEFT JOIN {{grams}} g ON g.h3 = k3 LEFT JOIN singles s ON s.h1 = k1
)
SELECT stopped, classed, k1, k3, n,
       CASE WHEN stopped THEN coalesce(i3 >= {LEAST_INSIDE} AND e3 / (e3 + i3) <= {LOW_SHARE}, false) ELSE share < least END AS is_cut
FROM judged
"""

BLANK = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace()) + "\ufffd"
ARGS = {
    "ws": f"[{WS}]+", "nl": "\n", "cr": "\r", "tab": "\t", "nbsp": "\xa0", "blank": BLANK, "letter": r"[\p{L}\p{N}]", "outer": ".,;:!?()[]{}\"'“”‘’«»", "closing": "\"'”’»)]",
    "tag": r"</?[a-zA-Z!][^<>]*>", "entity": r"&(?:amp;)?(?:lt|gt|quot|apos|nbsp|#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);",
    "mask": r" [A-Z]?+[a-z\-,.;:()/']*+[0-9A-Z](?:[^ ]*[^ .!?,;:\"”’)\]])?",
    "no_text": NO_TEXT, "cut_mark": CUT_MARK, "open_tag": OPEN_TAG, "open_entity": OPEN_ENTITY, "terminated": TERMINATED,
    "address": ADDRESS, "keywords": KEYWORDS, "bracketed": BRACKETED,
}


def cut_records(df: DataFrame, row_id: str, text: str, source: str, judged: DataFrame | None = None) -> DataFrame:
    """(row_id, source, is_cut) for every row of ``judged`` (by default of ``df``); the counts are always of ``df``. Placeholders, null and blank texts are never cut.

    A text is cut if it stops inside a tag or an entity, ends in a mark of truncation, or lacks a full stop and its final trigram is
    frequent inside sentences but almost never at their ends. A final trigram that is rare falls back on its last
    word, and a last word seen nowhere else is a piece of a word. Texts are read whole; ties and repeated rows don't
    matter, as every row is judged by itself; an empty table gives an empty table.
    """

    def run(sql: str, rows: DataFrame) -> DataFrame:
        sql = sql.replace("$id", f"`{row_id}`").replace("$text", f"`{text}`").replace("$source", f"`{source}`")
        used = {k: v for k, v in ARGS.items() if re.search(rf":{k}\b", sql)}
        return df.sparkSession.sql(sql, args=used, df=rows.select(row_id, text, source))

    # what is kept is small beside the texts: a count per trigram, and a few numbers per row
    grams = checkpointed(run(COUNT, df))
    asked = checkpointed(run(JUDGE, df if judged is None else judged))
    endings = checkpointed(df.sparkSession.sql(ENDINGS, asked=asked, grams=grams))
    open_rows = join_aggregate(asked.filter("verdict IS NULL"), endings, ["stopped", "classed", "k1", "k3"], "n").select("id", "src", "is_cut")
    out = open_rows.unionByName(asked.filter("verdict IS NOT NULL").select("id", "src", F.col("verdict").alias("is_cut")))
    return out.select(F.col("id").alias(row_id), F.col("src").alias(source), "is_cut")


def cut_shares(cut: DataFrame, source: str) -> DataFrame:
    """(source, n_texts, n_cut, cut_share) per source; a null source is its own group."""
    return cut.groupBy(source).agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut")).withColumn("cut_share", F.col("n_cut") / F.col("n_texts"))


def is_no_text(c: Column) -> Column:
    """True for null, blank and placeholder texts."""
    s = F.coalesce(c, F.lit(""))
    return ~s.rlike(r"[\p{L}\p{N}]") | (F.length(s) < 400) & F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "").rlike(NO_TEXT)
