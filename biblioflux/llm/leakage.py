"""Evaluation texts leaking into a corpus: spaced-seed hash hits, verified by substitution-tolerant overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed, written

# Masks of token positions that count (1) and are ignored (0).
MASKS = ("11011011", "111001011", "1100110101")
#: Windows that count as an overlap: at most this share of changed words, at least this many words. Short windows must agree in full, as
#: sentences of a common pattern agree in 15 words but for one without being copies.
LIMITS = ((0.0, 15), (0.10, 20), (0.12, 40))
#: Where the overlap is the whole passage or the whole document, no pattern around it is left to explain it: this share of changed
#: words from LEAST_WORDS on.
WHOLE_SHARE = 0.10
#: A shorter passage is no case in part, only as a whole; it has a seed of all its words besides.
LEAST_WORDS = min(n for _, n in LIMITS)

#: The filter of the test side's seeds has so many bits a seed at least, up to MAX_FILTER_BITS (128 MiB); a larger test side is searched
#: in blocks of passages, each with a filter of its own, so that what a task holds never grows with the data.
BITS_PER_SEED = 32
MAX_FILTER_BITS = 1 << 30
PROBES = 6
#: Unit in which parts of a filter are merged.
SEGMENT_BITS = 1 << 19

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});")
_REFERENCE = re.compile(r"\[\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\]|\(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\)|\^\d{1,3}\b|[¹²³⁰-⁹]+")
_JOINED = re.compile(r"(?<=\w)[-‐‑]\s*(?=\w)|(?<=\d)[.,](?=\d)|['’ʼ]|[­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words in lower case without markup, reference numbers, punctuation and hyphens (hyphenation at line ends included)."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return _WORD.findall(_JOINED.sub("", _REFERENCE.sub(" ", text)).lower())


class Hashes:
    """64-bit word hashes with a bounded memory."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(h: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For every mask, the hash of the counting words at each position, and the mask's number."""
    out = []
    for k, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        acc = np.full(n, k + 1, dtype=np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                acc = (acc ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                acc ^= acc >> np.uint64(29)
        out.append((acc, k))
    return out


def overlap_many(line: np.ndarray, begin: np.ndarray, end: np.ndarray, items: np.ndarray, first: np.ndarray, last: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each candidate, whether its texts agree along one diagonal in a window by LIMITS, or as a whole but for WHOLE_SHARE.

    Document k is line[begin[k]:end[k]], its passage items[first[k]:last[k]], and word i of the passage stands beside word
    i + offset[k] of the document. Candidates are handled together, as many as fit a bounded matrix.
    """
    out = np.zeros(len(begin), dtype=bool)
    width = int((last - first).max(initial=0))
    step = max(1, 1_000_000 // max(1, width))
    for s in range(0, len(begin), step):
        b, e, f, z, o = (x[s : s + step, None] for x in (begin, end, first, last, offset))
        i = np.arange(width)[None, :]
        at = b + o + i
        valid = (f + i < z) & (at >= b) & (at < e)
        same = valid & (line[np.where(valid, at, 0)] == items[np.where(valid, f + i, 0)])
        beside = valid.sum(axis=1)
        whole = (beside > 0) & ((beside == (z - f)[:, 0]) | (beside >= LEAST_WORDS) & (beside == (e - b)[:, 0]))
        out[s : s + step] = whole & (same.sum(axis=1) >= (1 - WHOLE_SHARE) * beside - 1e-9)
        # a window (i, j] fits if its agreed words less (1 - share) of its length aren't below 0; positions outside never agree
        agreed = np.concatenate([np.zeros((len(same), 1)), np.cumsum(same, axis=1)], axis=1)
        for share, least in LIMITS:
            if width < least:
                break
            level = agreed - (1 - share) * np.arange(width + 1)[None, :]
            lowest = np.minimum.accumulate(level, axis=1)
            out[s : s + step] |= (lowest[:, : width + 1 - least] <= level[:, least:] + 1e-9).any(axis=1)
    return out


def overlaps(doc: np.ndarray, item: np.ndarray, offset: int) -> bool:
    """Whether one document and one passage agree along one diagonal (document position less passage position)."""
    one = [np.array([x]) for x in (0, len(doc), 0, len(item), offset)]
    return bool(len(doc) and len(item) and overlap_many(doc, one[0], one[1], item, one[2], one[3], one[4])[0])


def whole_seeds(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of n successive words at each position, for passages of n < LEAST_WORDS words."""
    acc = np.full(max(0, len(h) - n + 1), 1000 + n, dtype=np.uint64)
    for i in range(n):
        acc = (acc ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc


def _probe(seed: np.ndarray, k: int, bits: int) -> np.ndarray:
    mixed = (seed ^ np.uint64(k * 0x51ED2701)) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ mixed >> np.uint64(32)) & np.uint64(bits - 1)


def might_hold(filled: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Positions of the seeds that the filter may hold; every probe looks only at what the ones before left."""
    at = np.arange(len(seed))
    for k in range(PROBES):
        spot = _probe(seed[at], k, len(filled) * 8)
        at = at[filled[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return at


def item_words(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(item, n, words): the word hashes of every passage that has words, as bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            own = [hashes.of(words_of(t)) for t in pdf[passage]]
            out = pd.DataFrame({"item": pdf[item_id], "n": [len(w) for w in own], "words": [w.tobytes() for w in own]})
            yield out[out["n"] > 0]

    usable = items.select(item_id, passage).filter(F.col(item_id).isNotNull() & F.col(passage).isNotNull())
    return usable.mapInPandas(make, "item long, n int, words binary")


def item_seeds(words: DataFrame) -> DataFrame:
    """(seed, item, at, whole): the seeds of every passage; ``whole`` marks the one of all words of a short passage."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for i, w in zip(pdf["item"], pdf["words"], strict=True):
                h = np.frombuffer(w, dtype=np.uint64)
                found = [(acc, False) for acc, _ in seeds(h)] + ([(whole_seeds(h, len(h)), True)] if len(h) < LEAST_WORDS else [])
                parts += [pd.DataFrame({"seed": acc.astype(np.int64), "item": i, "at": np.arange(len(acc)), "whole": whole}) for acc, whole in found]
            if parts:
                yield pd.concat(parts)

    return words.mapInPandas(make, "seed long, item long, at long, whole boolean")


def seed_filter(item_side: DataFrame, bits: int) -> np.ndarray:
    """The filter of so many bits that holds the seeds of the test side. Tasks fill segments of it, equal segments are merged by OR, and
    the driver puts together at most MAX_FILTER_BITS."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["seed"].to_numpy(dtype=np.int64).astype(np.uint64)
            spots = np.unique(np.concatenate([_probe(own, k, bits) for k in range(PROBES)])) if len(own) else own
            for segment in np.unique(spots // np.uint64(SEGMENT_BITS)):
                local = (spots[spots // np.uint64(SEGMENT_BITS) == segment] % np.uint64(SEGMENT_BITS)).astype(np.int64)
                flags = np.zeros(SEGMENT_BITS, dtype=np.uint8)
                flags[local] = 1
                yield pd.DataFrame({"segment": [int(segment)], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        together = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "bits": [together.tobytes()]})

    shape = "segment long, bits binary"
    filled = np.zeros(bits // 8, dtype=np.uint8)
    for row in item_side.select("seed").mapInPandas(fill, shape).groupBy("segment").applyInPandas(merge, shape).collect():
        filled[row["segment"] * SEGMENT_BITS // 8 : (row["segment"] + 1) * SEGMENT_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return filled


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(doc_id, item_id) of every document that contains a passage or enough of its successive words.

    Both ids are longs; rows with a null id are left out; whole texts are read; null and empty texts have no leaks, and a passage of
    fewer than LEAST_WORDS words is found where it stands as a whole. Repeated documents count on their own; repeated item ids give one
    row. Documents are read once for each block of the test side and keep only the seeds that the block's filter may hold; these are
    joined with the test side's seeds, two hits on a diagonal make a candidate, and candidates are verified on all words.
    """
    words = checkpointed(item_words(items, item_id, passage))
    total, lengths = words.agg(F.sum("n") * (len(MASKS) + 1), F.collect_set(F.when(F.col("n") < LEAST_WORDS, F.col("n")))).first()
    blocks = max(1, -(-(total or 0) * BITS_PER_SEED // MAX_FILTER_BITS))
    out = None
    for block in range(blocks):
        own = words.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else words
        found = _block_leaks(docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()), doc_id, text, own, sorted(lengths), (total or 0) // blocks + 1)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("d").alias(doc_id), F.col("item").alias(item_id)).distinct()


def _block_leaks(docs: DataFrame, doc_id: str, text: str, words: DataFrame, lengths: list[int], total: int) -> DataFrame:
    bits = SEGMENT_BITS
    while bits < min(total * BITS_PER_SEED, MAX_FILTER_BITS):
        bits *= 2
    item_side = checkpointed(item_seeds(words))
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(item_side, bits))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        gap = np.zeros(max([LEAST_WORDS, *map(len, MASKS)]), dtype=np.uint64)

        def flush(docs: list[int], parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            """Hits of many documents at once; their words stand in one row, with gaps between them."""
            line = np.concatenate([x for p in parts for x in (p, gap)])
            starts = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
            seed, at, alone = [], [], []
            for acc, short in [*((acc, False) for acc, _ in seeds(line)), *((whole_seeds(line, n), True) for n in lengths)]:
                where = might_hold(shared.value, acc)
                seed, at, alone = [*seed, acc[where]], [*at, where], [*alone, np.full(len(where), short)]
            seed, at, alone = (np.concatenate(x) for x in (seed, at, alone))
            own = np.searchsorted(starts, at, "right") - 1
            # one hit is enough only for a short passage as a whole
            hits = np.bincount(own, minlength=len(parts)) + np.bincount(own, weights=alone, minlength=len(parts))
            keep = np.flatnonzero(hits >= 2)
            if not len(keep):
                return
            order = np.argsort(own, kind="stable")
            first, last = np.searchsorted(own[order], keep, "left"), np.searchsorted(own[order], keep, "right")
            rows = [order[a:b] for a, b in zip(first, last, strict=True)]
            yield pd.DataFrame({
                "d": [docs[k] for k in keep], "key": [xxhash.xxh64_intdigest(parts[k].tobytes()) - (1 << 63) for k in keep], "words": [parts[k].tobytes() for k in keep],
                "seeds": [seed[r].astype(np.int64) for r in rows], "ats": [at[r] - starts[k] for k, r in zip(keep, rows, strict=True)],
            })

        for pdf in batches:
            own, parts, n = [], [], 0
            for i, t in zip(pdf[doc_id], pdf[text], strict=True):
                own.append(i)
                parts.append(hashes.of(words_of(t)))
                n += len(parts[-1])
                if n > 500_000:
                    yield from flush(own, parts)
                    own, parts, n = [], [], 0
            if parts:
                yield from flush(own, parts)

    hit = docs.select(doc_id, text).mapInPandas(search, "d long, key long, words binary, seeds array<long>, ats array<long>")
    hit = written(hit)
    places = hit.select("d", "key", F.inline(F.arrays_zip("seeds", "ats"))).withColumnsRenamed({"seeds": "seed", "ats": "doc_at"})
    # a seed of stock wording can stand in very many documents: join_aggregate splits it
    asked = places.groupBy("seed").agg(F.count("*").alias("n"))
    met = checkpointed(item_side.join(asked, "seed"))
    offsets = join_aggregate(places, met, ["seed"], "n").groupBy("d", "key", "item", (F.col("doc_at") - F.col("at")).alias("offset")).agg(F.count("*").alias("hits"), F.max("whole").alias("whole"))
    wanted = offsets.filter("hits >= 2 OR whole").groupBy("d", "key", "item").agg(F.collect_set("offset").alias("offsets"))
    wanted = checkpointed(wanted)
    passages = words.withColumnRenamed("words", "passage").join(wanted.groupBy("item").agg(F.count("*").alias("times")), "item").select("item", "passage", "times")
    candidates = join_aggregate(wanted, checkpointed(passages.dropDuplicates()), ["item"], "times")
    both = candidates.join(hit.select("d", "key", "words").dropDuplicates(["d", "key"]), ["d", "key"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct values in one row, and where each of the given values begins and ends in it."""
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(v, len(known)) for v in values])
            parts = [np.frombuffer(v, dtype=np.uint64) for v in known]
            ends = np.cumsum([0, *map(len, parts)])
            return np.concatenate(parts), ends[which], ends[which + 1]

        for pdf in batches:
            # rows are handled in runs whose documents have a bounded number of words together
            sizes = pdf["words"].map(len).to_numpy() // 8
            runs = np.cumsum(sizes) // 2_000_000
            for _, part in pdf.groupby(runs, sort=False):
                line, begin, end = row(part["words"].tolist())
                items, first, last = row(part["passage"].tolist())
                n = part["offsets"].map(len).to_numpy()
                own = np.repeat(np.arange(len(part)), n)
                good = overlap_many(line, begin[own], end[own], items, first[own], last[own], np.concatenate(part["offsets"].tolist()))
                yield part.loc[np.isin(np.arange(len(part)), own[good]), ["d", "item"]]

    return both.select("d", "item", "words", "passage", "offsets").mapInPandas(verify, "d long, item long")
