"""Best value of each field per duplicate group by token-level consensus over progressively aligned values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from biblioflux.operators.skew import join_aggregate
from biblioflux.session import checkpointed

#: Values that are aligned in one call. The values of a larger group are aligned by blocks, and the blocks' frames with one another.
BLOCK = 64

_FRAME = StructType([StructField("tokens", ArrayType(StringType())), StructField("weights", ArrayType(DoubleType()))])
_VOTES = ArrayType(StructType([StructField("c", IntegerType()), StructField("t", StringType()), StructField("other", BooleanType())]))


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by bit-parallel dynamic programming (one big integer per token of b)."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    where: dict[str, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row, rows = full, []
    for w in y:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    pairs = []
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        # a zero bit at i in row j: the subsequence grows at x[i] within y[: j + 1]
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            pairs.append((start + i, start + j))
            i, j = i - 1, j - 1
    middle = pairs[::-1]
    return [(k, k) for k in range(start)] + middle + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def aligned(line: list[str], tokens: list[str]) -> list[tuple[int | None, int | None]]:
    """Pairs (column, token) of an alignment: equal tokens of a longest common subsequence stand together, between two of them tokens
    and columns stand together one by one, and the rest of either side stands alone."""
    out, i, j = [], 0, 0
    for at, to in [*lcs_pairs(line, tokens), (len(line), len(tokens))]:
        for n in range(max(at - i, to - j)):
            out.append((i + n if i + n < at else None, j + n if j + n < to else None))
        if at < len(line):
            out.append((at, to))
        i, j = at + 1, to + 1
    return out


def heaviest(column: dict[str, float], lead: str | None = None) -> str:
    """The token with the most weight; of equals ``lead``, then the one that came first."""
    most = max(column.values())
    return lead if column.get(lead) == most else next(t for t, w in column.items() if w == most)


def frame(values: list[tuple[list[str], list[float]]]) -> tuple[list[str], list[float]]:
    """The progressive alignment of values given as tokens with weights: the leading token of each column and its weight.

    Values join in the order of falling weight, of equals in the order given, each aligned with the leading tokens so far. A value without a token for a column
    casts no vote there: fields lose text, so a gap is no evidence against it.
    """
    order = sorted(range(len(values)), key=lambda k: -max(values[k][1], default=0.0))
    columns: list[dict[str, float]] = []
    line: list[str] = []
    for k in order:
        tokens, weights = values[k]
        grown: list[dict[str, float]] = []
        for c, t in aligned(line, tokens):
            column = columns[c] if c is not None else {}
            if t is not None:
                column[tokens[t]] = column.get(tokens[t], 0.0) + weights[t]
            grown.append(column)
        columns = grown
        line = [heaviest(c) for c in columns]
    return line, [c[t] for c, t in zip(columns, line, strict=True)]


def votes(line: list[str], tokens: list[str]) -> list[tuple[int, str]]:
    """(column, token) of every token that stands in a column of the frame."""
    return [(c, tokens[t]) for c, t in aligned(line, tokens) if c is not None and t is not None]


def consensus(values: list[list[str]], weights: list[float]) -> list[str]:
    """The token with the most weight of each column of the values' frame, every value voting along its own alignment with it."""
    line, _ = frame([(v, [w] * len(v)) for v, w in zip(values, weights, strict=True)])
    columns: list[dict[str, float]] = [{} for _ in line]
    for v, w in zip(values, weights, strict=True):
        for c, t in votes(line, v):
            columns[c][t] = columns[c].get(t, 0.0) + w
    return [heaviest(c, lead) for c, lead in zip(columns, line, strict=True) if c]


def distance(tokens: list[str], agreed: list[str]) -> int:
    """Insertions and deletions of tokens between a value and the consensus."""
    return len(tokens) + len(agreed) - 2 * len(lcs_pairs(tokens, agreed))


def closest(values: list[list[str]], weights: list[float], levels: list[int] | None = None) -> int:
    """Index of the value nearest to the consensus of all among those of the least level; the first of equals."""
    if len(values) == 1:
        return 0
    agreed = consensus(values, weights)
    levels = levels or [0] * len(values)
    return min((k for k, n in enumerate(levels) if n == min(levels)), key=lambda k: (distance(values[k], agreed), k))


@F.pandas_udf(IntegerType())
def _pick(texts: pd.Series, weights: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([closest([v.split() for v in t], list(w), list(n)) for t, w, n in zip(texts, weights, levels, strict=True)], dtype="int32")


@F.pandas_udf(_FRAME)
def _frame(tokens: pd.Series, weights: pd.Series) -> pd.DataFrame:
    rows = [frame([(list(t), list(w)) for t, w in zip(ts, ws, strict=True)]) for ts, ws in zip(tokens, weights, strict=True)]
    return pd.DataFrame(rows, columns=["tokens", "weights"])


@F.pandas_udf(_VOTES)
def _votes(texts: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([[{"c": c, "t": t, "other": t != line[c]} for c, t in votes(list(line), v.split())] for v, line in zip(texts, lines, strict=True)])


@F.pandas_udf(LongType())
def _distance(texts: pd.Series, agreed: pd.Series) -> pd.Series:
    return pd.Series([distance(v.split(), list(a)) for v, a in zip(texts, agreed, strict=True)], dtype="int64")


def best_values(values: DataFrame, group: list[str], row_id: str, value: str, level: Column, weight: Column, order: list[Column], repeated: Column | bool = True) -> DataFrame:
    """(group columns, row_id): the row whose value is closest to its group's token consensus.

    Every distinct value of a group votes for its tokens with ``weight``, its trust; where ``repeated`` holds, with the sum over the
    records that have it. Of the values of the group's least ``level`` the one closest to the consensus survives, of equals the first by
    ``order``; the row is the first one by ``order`` that has this value. A group of more than BLOCK distinct values is aligned in a tree
    of blocks whose frames are aligned in turn; votes and distances are then counted over all values by rows, so no task gathers an
    unbounded group. Null values should be filtered out before; an empty table gives an empty one.
    """
    repeated = F.lit(repeated) if isinstance(repeated, bool) else repeated
    rank = F.struct(level.alias("level"), *[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = values.select(*group, F.col(row_id).alias("row"), F.col(value).alias("text"), rank.alias("rank"), weight.cast("double").alias("w"), repeated.alias("sum"))
    heavy = F.when(F.max("sum"), F.sum("w")).otherwise(F.max("w")).alias("w")
    distinct = rows.groupBy(*group, "text").agg(F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank"), heavy)
    distinct = checkpointed(distinct)
    sizes = distinct.groupBy(*group).agg(F.count("*").alias("n"), F.min("rank.level").alias("least"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    small = distinct
    if most > BLOCK:
        sized = checkpointed(join_aggregate(distinct, checkpointed(sizes), group, "n", most=most))
        small = sized.filter(F.col("n") <= BLOCK).drop("n", "least")
    lists = small.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "row", "text", "w"))).alias("v"))
    picked = F.when(F.size("v") == 1, F.lit(0)).otherwise(_pick(F.col("v.text"), F.col("v.w"), F.col("v.rank.level")))
    won = lists.select(*group, F.get("v", picked).alias("b")).select(*group, F.col("b.row").alias(row_id))
    if most <= BLOCK:
        return won
    return won.unionByName(_large_groups(sized.filter(F.col("n") > BLOCK), group, most).withColumnRenamed("row", row_id))


def _large_groups(sized: DataFrame, group: list[str], most: int) -> DataFrame:
    tokens = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    frames = sized.select(*group, "n", "rank", F.xxhash64("text").alias("h"), tokens.alias("tokens"), F.transform(tokens, lambda _: F.col("w")).alias("weights"))
    left = most
    while left > 1:
        # blocks by a hash; a block holds half of BLOCK on average, so that few exceed it
        left = -(-left * 2 // BLOCK) if left > BLOCK else 1
        blocks = F.pmod("h", F.lit(left)) if left > 1 else F.lit(0)
        gathered = frames.groupBy(*group, blocks.alias("h")).agg(F.max("n").alias("n"), F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "tokens", "weights"))).alias("f"))
        made = gathered.select(*group, "n", "rank", "h", _frame(F.col("f.tokens"), F.col("f.weights")).alias("m"))
        frames = checkpointed(made.select(*group, "n", "rank", F.xxhash64("h").alias("h"), "m.tokens", "m.weights"))
    lines = frames.select(*group, "n", F.col("tokens").alias("line"))
    cast = join_aggregate(sized.drop("n"), lines, group, "n", most=most).select(*group, "w", "rank", F.inline(_votes("text", "line")))
    columns = cast.groupBy(*group, "c", "t").agg(F.sum("w").alias("w"), F.min("other").alias("other"), F.min("rank").alias("rank"))
    leading = columns.groupBy(*group, "c").agg(F.min_by("t", F.struct(-F.col("w"), "other", "rank", "t")).alias("t"))
    agreed = leading.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("a")).select(*group, F.col("a.t").alias("agreed"))
    agreed = checkpointed(agreed.join(lines.select(*group, "n"), group))
    trusted = sized.filter(F.col("rank.level") == F.col("least")).select(*group, "text", "row", "rank")
    near = join_aggregate(trusted, agreed, group, "n", most=most).withColumn("d", _distance("text", "agreed"))
    return near.groupBy(*group).agg(F.min_by("row", F.struct("d", "rank")).alias("row"))
