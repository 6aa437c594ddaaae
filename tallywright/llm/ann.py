"""Nearest neighbours by inner product over shifted Hilbert orderings, completed by a bounded block scan.

1. Vectors are projected on a few random orthonormal directions, shifted, cut into cells, and the cells numbered along a Hilbert curve;
   several curves have their own directions and shift. Spark range-partitions each curve by key; within a partition every query
   looks at a window of neighbours on either side. The windows of all curves merge, are scored exactly and give each query a floor:
   the score of its k-th best so far.
2. Windows alone find too little where data have no low-dimensional structure (isotropic 64-dimensional vectors need windows of over
   half of all rows for a recall of 0.9). So the rows, grouped along the first curve, are scanned for each block of queries,
   except groups whose centre and radius prove that no row of theirs reaches the query's floor. Queries are numbered into blocks along
   the first curve; the pairs of group and block that may hold anything are told from a row per group, and only those are shuffled,
   a task's call holding one group and one block. The result is exact.

Inner products are computed in double precision on the original vectors, each in one fixed order, so equal vectors score equally; ties
go to the smaller id. Defined results: rows whose vector is null, zero, of another length than most, or holds a null or non-finite
number take no part, nor do rows with a null id; repeated rows are rows each, as candidates and as queries (an id's answers are ranked
together); a query never finds rows of its own id; with fewer than k candidates all are returned; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import materialize
from tallywright.operators.tables import numbered

CURVES, AXES, BITS, WINDOW = 3, 8, 7, 256
GROUP_ROWS, BLOCK_QUERIES, STEP = 8192, 4096, 512
MARGIN = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of small non-negative integers along the Hilbert curve (Skilling's transposition, over all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    keys = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> b) & 1)
    return keys


def curve_keys(vectors: np.ndarray, curve: int, seed: int = 5) -> np.ndarray:
    """Hilbert keys of unit-scaled vectors under one curve's directions and shift."""
    rng = np.random.default_rng([seed, curve])
    d = vectors.shape[1]
    axes = np.linalg.qr(rng.normal(size=(d, min(AXES, d))))[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    spread = 4 / np.sqrt(d)  # nearly all of a random direction's projections
    at = (unit @ axes / spread + 1) / 2 + rng.uniform(-0.25, 0.25, axes.shape[1])
    return hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one query, each summed in the same order."""
    return np.cumsum(rows * query, axis=1)[:, -1] if len(rows) else np.zeros(0)


def best(query: np.ndarray, query_id: int, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows, given rough scores that are right to MARGIN; rows below ``floor`` may be left out."""
    size = max(1.0, float(np.abs(rough).max(initial=0)))
    allowed = (ids != query_id) & (rough >= floor - MARGIN * size)
    here = np.flatnonzero(allowed)
    if len(here) > k:
        kth = np.partition(rough[here], len(here) - k)[len(here) - k]
        here = here[rough[here] >= kth - MARGIN * size]
    exact = scores(query, rows[here])
    order = np.lexsort((ids[here], -exact))[:k]
    return ids[here][order], exact[order]


def clean(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, is_query, vec (doubles as bytes) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys = [curve_keys(m, c) if len(m) else np.zeros(0, np.int64) for c in range(CURVES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in m], pa.binary()), *map(pa.array, keys)], names=["vec_id", "is_query", "vec", *[f"key{c}" for c in range(CURVES)]])

    return rows.where(F.size("v") == dim).mapInArrow(pack, "vec_id long, is_query boolean, vec binary, " + ", ".join(f"key{c} long" for c in range(CURVES)))


def _matrix(vecs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1) if vecs else np.zeros((0, 1))


def _windows(k: int, window: int):
    """Rows of one range partition in key order → each query's best within the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, vecs = [], [], []
        begun = 0  # rows before this one have been asked already

        def answer(last: bool):
            nonlocal ids, asked, vecs, begun
            upto = len(ids) if last else max(begun, len(ids) - window)
            found: list[tuple[int, float]] = []
            if any(asked[begun:upto]):
                n, m = np.array(ids), _matrix(vecs)
                for i in range(begun, upto):
                    if asked[i]:
                        a, b = max(0, i - window), i + window + 1
                        got, value = best(m[i], ids[i], n[a:b], m[a:b], m[a:b] @ m[i], k)
                        found += [(ids[i], int(x), float(s)) for x, s in zip(got, value, strict=True)]
            drop = max(0, upto - window)
            ids, asked, vecs, begun = ids[drop:], asked[drop:], vecs[drop:], upto - drop
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            ids += b.column(0).to_pylist()
            asked += b.column(1).to_pylist()
            vecs += b.column(2).to_pylist()
            yield answer(False)
        yield answer(True)

    return run


def _spheres(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole groups, each group's together → centre and radius of each."""

    def sphere(parts: list[np.ndarray]) -> tuple[bytes, float]:
        n = sum(len(m) for m in parts)
        centre = sum(m.sum(0) for m in parts) / n
        return centre.tobytes(), float(np.sqrt(max(((m - centre) ** 2).sum(1).max() for m in parts)))

    at, parts = None, []
    for b in batches:
        for g, part in b.groupby("g"):
            if g != at and parts:
                yield pd.DataFrame([(at, *sphere(parts))], columns=["g", "centre", "radius"])
                parts = []
            at = int(g)
            parts.append(_matrix(list(part["vec"])))
    if parts:
        yield pd.DataFrame([(at, *sphere(parts))], columns=["g", "centre", "radius"])


def _live(centres: np.ndarray, radii: np.ndarray, groups: np.ndarray):
    """Queries → the pairs of their block with groups that may hold a row for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, q, floor = b.column(0).to_numpy(), _matrix(b.column(1).to_pylist()), b.column(2).to_numpy()
            found: set[tuple[int, int]] = set()
            for a in range(0, len(block), STEP):
                part = q[a : a + STEP]
                reach = part @ centres.T + np.linalg.norm(part, axis=1)[:, None] * radii
                live = reach + np.abs(reach) * 1e-12 + MARGIN >= floor[a : a + STEP, None]
                for x in np.unique(block[a : a + STEP]):
                    found.update((int(x), int(g)) for g in groups[live[block[a : a + STEP] == x].any(0)])
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["block", "g"])

    return run


def _scan(k: int):
    """One group of rows with one block of queries → each query's best in the group, where the group may hold any."""

    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(block):
            rows = rows.sort_values("vec_id")
            ids, m = rows["vec_id"].to_numpy(), _matrix(list(rows["vec"]))
            centre = m.mean(0)
            radius = float(np.sqrt(((m - centre) ** 2).sum(1).max()))
            for a in range(0, len(block), STEP):
                part = block.iloc[a : a + STEP]
                q, floor = _matrix(list(part["vec"])), part["floor"].to_numpy()
                reach = q @ centre + np.linalg.norm(q, axis=1) * radius
                live = np.flatnonzero(reach + np.abs(reach) * 1e-12 + MARGIN >= floor)
                rough = q[live] @ m.T
                for j, i in enumerate(live):
                    got, value = best(q[i], int(part["query_id"].iloc[i]), ids, m, rough[j], k, float(floor[i]))
                    out.append(pd.DataFrame({"query_id": int(part["query_id"].iloc[i]), "vec_id": got, "score": value}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", window: int = WINDOW, group_rows: int = GROUP_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row where ``is_query`` holds."""
    rows = materialize(clean(vectors, is_query, id_col, vector_col), "vectors")
    n = rows.count()
    schema = "query_id long, vec_id long, score double"
    near = None
    for c in range(CURVES):
        ordered = rows.select("vec_id", "is_query", "vec", f"key{c}").repartitionByRange(max(1, -(-n // (4 * group_rows))), f"key{c}", "vec_id").sortWithinPartitions(f"key{c}", "vec_id")
        part = ordered.select("vec_id", "is_query", "vec").mapInArrow(_windows(k, window), schema)
        near = part if near is None else near.unionByName(part)
    floors = _top(near.distinct(), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vec", "key0").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # groups and blocks are cut by position, so that their number follows the rows and not the partitions
    grouped = numbered(rows.select("vec_id", "vec", "key0"), ["key0", "vec_id"]).select(F.floor(F.col("position") / group_rows).alias("g"), "vec_id", "vec")
    grouped = materialize(grouped, "groups")
    spheres = grouped.select("g", "vec").repartition("g").sortWithinPartitions("g").mapInPandas(_spheres, "g long, centre binary, radius double").orderBy("g").collect()
    asked = numbered(queries, ["key0", "query_id"]).select(F.floor(F.col("position") / block_queries).alias("block"), "query_id", "vec", "floor")
    asked = materialize(asked, "asked")
    if not spheres:
        return _top(near, k).select("query_id", "rank", "vec_id", "score")
    live = _live(_matrix([r["centre"] for r in spheres]), np.array([r["radius"] for r in spheres]), np.array([r["g"] for r in spheres], np.int64))
    pairs = materialize(asked.select("block", "vec", "floor").mapInArrow(live, "block long, g long").distinct(), "pairs")
    found = grouped.join(pairs, "g").groupBy("g", "block").cogroup(asked.join(pairs, "block").groupBy("g", "block")).applyInPandas(_scan(k), schema)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
