"""Filling fixed-capacity packs with texts by minimum bin slack over token lengths."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflux.session import checkpointed

#: Ranks of a public byte-level tokenizer; the driver reads the file from this path and sends it to the tasks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How that tokenizer cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that are packed together in one task.
SHARD = 4096
#: Packs filled to this share are final in the first rounds; the items of the others go on to a round with fewer shards.
FULL = 0.995


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row with an id; 0 for null and empty texts. Texts are counted whole."""
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("pack", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"d": pdf[doc_id], "n": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf[text]]}).astype({"n": "int64"})

    return docs.select(doc_id, text).filter(F.col(doc_id).isNotNull()).mapInPandas(count, f"d {dict(docs.dtypes)[doc_id]}, n long").select(F.col("d").alias(doc_id), F.col("n").alias("n_tokens"))


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (repeats included) whose sum comes nearest to ``room`` without exceeding it, by a bitset of the reachable sums.

    ``lengths`` is sorted and holds the available lengths. Longer ones are tried first, and the search ends as soon as the room
    can be filled exactly.
    """
    bits, target, trail = 1, 1 << room, []
    within = (1 << (room + 1)) - 1
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[k]
        for _ in range(min(counts[n], room // n)):
            grown = bits | (bits << n & within)
            if grown == bits:
                break
            trail.append((n, bits))
            bits = grown
        if bits & target:
            break
    rest, out = bits.bit_length() - 1, []
    for n, before in reversed(trail):
        if not before >> rest & 1:
            out.append(n)
            rest -= n
    return out


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The number of the pack (from 0) of each item: a first item, then the fullest combination beside it, again and again.

    First come the lengths that leave the most room in packs of their own kind, as those just above a half or a third of the
    capacity; left to the end they would find no partners. Every size must be from 1 to ``capacity``.
    """
    where: dict[int, list[int]] = {}
    for k in range(len(sizes) - 1, -1, -1):
        where.setdefault(sizes[k], []).append(k)
    lengths = sorted(where)
    counts = {n: len(w) for n, w in where.items()}
    out, number = [0] * len(sizes), 0

    def take(n: int) -> None:
        out[where[n].pop()] = number
        counts[n] -= 1
        if not counts[n]:
            del lengths[bisect_right(lengths, n) - 1]

    for first in sorted(where, key=lambda n: (capacity % n, n), reverse=True):
        while counts[first]:
            take(first)
            for n in fullest(lengths, counts, capacity - first):
                take(n)
            number += 1
    return out


def _packer(round_: int, last: bool):
    """Packs the items of one shard; packs below FULL aren't final before the last round."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # in a fixed order, so that a task that runs again gives the same packs
        pdf = pdf.sort_values(["n", "k", "piece"], ignore_index=True)
        cap = int(pdf["cap"].iloc[0])
        numbers = pd.Series(pack(pdf["n"].tolist(), cap))
        fill = pdf["n"].groupby(numbers).transform("sum")
        pdf["pack_id"] = f"{round_}-" + pdf["shard"].astype(str) + "-" + numbers.astype(str)
        pdf["final"] = last | (fill >= FULL * cap)
        return pdf[["c", "cap", "d", "piece", "n", "k", "pack_id", "final"]]

    return one


def pack_documents(sizes: DataFrame, doc_id: str, n_tokens: str, capacities: DataFrame, capacity_id: str, capacity: str, shard: int = SHARD) -> DataFrame:
    """(capacity_id, pack_id, doc_id, piece, n_tokens): the pack of each document, or of each piece of one longer than the pack.

    Piece numbers count from 1; all pieces but the last fill a pack alone, and the last is packed like a document of its length.
    Documents without tokens, with a null id or size, and capacities below 1 give no rows; a repeated doc_id is packed once for
    each of its rows. Items are spread by a hash of their row over shards of about ``shard`` items, each packed in one task; the items of
    packs that stay below FULL meet again in fewer shards, until one shard is left or a round has left more than half of its shards'
    items over. The same rows always give the same packs.
    """
    copies = sizes.select(F.col(doc_id).alias("d"), F.col(n_tokens).alias("n")).filter("d is not null and n > 0").groupBy("d", "n").agg(F.count("*").alias("m"))
    # k tells repeated rows apart
    rows = copies.select("d", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy")).withColumn("k", F.xxhash64("d", "n", "copy"))
    caps = capacities.select(F.col(capacity_id).alias("c"), F.col(capacity).alias("cap")).filter("cap > 0").distinct()
    # a stated set of capacities against all rows: each document is packed once for every capacity
    each = rows.crossJoin(caps)
    pieces = F.floor((F.col("n") - 1) / F.col("cap"))
    each = each.withColumn("whole", pieces)
    alone = each.filter("whole > 0").select("c", "d", "cap", "n", "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))).alias("piece"))
    alone = alone.select("c", F.concat_ws("-", F.lit("f"), "d", "n", "copy", "piece").alias("pack_id"), "d", "piece", F.col("cap").alias("n"))
    items = each.select("c", "cap", "d", (F.col("whole") + 1).alias("piece"), (F.col("n") - F.col("whole") * F.col("cap")).alias("n"), "k")
    items = checkpointed(items)
    total = copies.agg(F.sum("m")).first()[0] or 0

    kind = dict(sizes.dtypes)[doc_id]
    shape = f"c {dict(capacities.dtypes)[capacity_id]}, cap long, d {kind}, piece long, n long, k long, pack_id string, final boolean"
    done, round_, before = [alone], 0, None
    while True:
        shards = max(1, -(-total // shard))
        last = shards == 1 or before is not None and 2 * shards > before
        packed = items.withColumn("cap", F.col("cap").cast("long")).withColumn("shard", F.pmod(F.xxhash64("c", "k", "piece", F.lit(round_)), F.lit(shards)))
        packed = checkpointed(packed.groupBy("c", "shard").applyInPandas(_packer(round_, last), shape))
        done.append(packed.filter("final").select("c", "pack_id", "d", "piece", "n"))
        if last:
            break
        items = packed.filter("not final").select("c", "cap", "d", "piece", "n", "k")
        most = items.groupBy("c").count().agg(F.max("count")).first()[0]
        if not most:
            break
        total, round_, before = min(most, total), round_ + 1, shards
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("c").alias(capacity_id), "pack_id", F.col("d").alias(doc_id), "piece", F.col("n").alias(n_tokens))
