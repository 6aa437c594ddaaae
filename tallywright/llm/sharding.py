"""Sharding: a uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

1. Each task permutes its own rows by a seeded hash key; nothing moves.
2. The counts per source partition and the shard sizes (at most one apart) are the margins of a random matrix: how many rows of each
   partition go to each shard under a uniform shuffle. Its margins are exact; it is drawn row by row from the multivariate
   hypergeometric law, whose probabilities are doubles (the first from log-gamma: relative error about 1e-6 at a billion rows).
3. Each partition deals its permuted rows by its matrix row: the first k0 to shard 0, the next k1 to shard 1, ...
4. Every shard permutes what it got by a second key. Position in that order is the slot. The order is found by hash ranges, so that no
   task holds a shard.

All rows stay in DataFrame operations; the driver draws the matrix from one count per source partition. Rows, whole, are written once
before the counts so that a lost executor cannot change which partition a row was counted in.

Defined results: nulls count as rows like any other; repeated rows are dealt independently; with fewer rows than shards some shards
are empty; an empty table gives no row. Existing columns named like the output (shard, slot) are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import materialize

ROWS_PER_RANGE = 1 << 17  # rows ordered by one task in step 4, about


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement from good + bad are good. Inversion outward from the mode, in doubles; should
    rounding leave a last share of about 1e-15 of the mass, the mode stands for it."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    comb = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(comb(good, mode) + comb(bad, draws - mode) - comb(good + bad, draws))
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
        if pl + pr < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of exact partition-to-shard counts whose margins are ``counts`` and ``sizes``."""
    rng, room, matrix = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest, left = [], n, sum(room)
        for size in room:
            k = hypergeometric(rng, size, left - size, rest)
            row.append(k)
            rest -= k
            left -= size
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, keys: list[str | Column], seed: int = 42) -> DataFrame:
    """``df`` with ``shard`` and ``slot``. ``keys`` seed the random order, with a row's place in its partition."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    salted = [F.col(k) if isinstance(k, str) else k for k in keys]
    # a row's place is part of its key, or copies would stand side by side and be dealt as one run; the key is written with the row
    local = df.withColumn("__key", F.xxhash64(F.lit(seed), *salted, F.monotonically_increasing_id())).withColumn("__part", F.spark_partition_id())
    local = local.sortWithinPartitions("__key").withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = materialize(local, "permuted")
    counted = sorted((r["__part"], r["count"]) for r in local.groupBy("__part").count().collect())  # a row per source partition
    total = sum(n for _, n in counted)
    matrix = communication_matrix([n for _, n in counted], even_sizes(total, shards), seed)
    spark = df.sparkSession
    edges = [(p, s, at, at + k) for (p, _), row in zip(counted, matrix, strict=True) for s, (at, k) in enumerate(zip(_running(row), row, strict=True)) if k]
    deals = spark.createDataFrame([(p, [e[2] for e in g], [e[1] for e in g]) for p, g in _grouped(edges)], "__part int, __from array<long>, __to array<int>")
    dealt = local.join(deals, "__part")
    dealt = dealt.withColumn("shard", F.element_at("__to", F.size(F.filter("__from", lambda x: x <= F.col("__at"))))).drop("__from", "__to")
    # the second permutation: by ranges of a fresh key, then within each range
    ranges = max(1, -(-total // (shards * ROWS_PER_RANGE)))
    mixed = dealt.withColumn("__key2", F.xxhash64(F.lit(seed + 1), F.col("__key"), F.col("__part"), F.col("__at")))
    mixed = mixed.withColumn("__range", F.pmod(F.shiftright("__key2", 20), F.lit(ranges)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = mixed.groupBy("shard", "__range").count().withColumn("__begin", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    ranked = mixed.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__key2", "__part", "__at")))
    return ranked.join(begins, ["shard", "__range"]).select(*keep, "shard", (F.col("__begin") + F.col("__rank") - 1).alias("slot"))


def _running(row: list[int]) -> list[int]:
    out, total = [], 0
    for k in row:
        out.append(total)
        total += k
    return out


def _grouped(edges: list[tuple]) -> list[tuple[int, list[tuple]]]:
    out: dict[int, list[tuple]] = {}
    for e in edges:
        out.setdefault(e[0], []).append(e)
    return list(out.items())
