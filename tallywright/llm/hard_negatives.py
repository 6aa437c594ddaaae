"""Hard-negative mining by inner product, with segment summaries that bound scores before they are computed.

Of each vector's segments the mean and the deviation are stored. Over a segment of m components, two vectors' inner product is m times
the product of their means, give or take at most m times the product of their deviations; sums over segments bound the score. Segments
are refined in steps: the whole vector, its halves, quarters, ... (summaries of larger segments follow from those of smaller ones), each
step on the rows that the one before has left, until exact scores of what remains are computed.

1. Anchors meet the rows of their label: a row stays while its upper bound reaches the k-th best lower bound. That gives positives.
2. Each positive's score opens a window of negative scores. Anchors meet the rows of other labels: a row stays while its bounds touch a
   window, and reach the k-th best lower bound of the rows that are surely inside.

Rows are sorted by label and numbered into groups of ``GROUP_ROWS``, anchors into blocks; a task's call holds one group and one block.
The pairs to be met are told from a label's first and last group, so a label that holds many of the rows spreads over many calls. Each
call returns at most k rows for an anchor or window. The number of rows met is anchors times rows, as the stated queries ask.

Defined results: components become floor(256 x); rows whose id, label or vector is null, or that hold a null or non-finite component,
take no part; rows are told apart as rows, so repeats of an id are each an anchor, and each other's other rows; only vectors of equal
length meet; ties go to the smaller id; positives without a negative in their window give no row; an empty table gives no row. A score
beyond 63 bits raises ValueError.
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

SEGMENTS = 16  # of the finest summary; a power of two
GROUP_ROWS, BLOCK_ANCHORS = 2048, 1024
LEAST, MOST = 30, 90  # a negative's score in hundredths of the positive's


def segment_edges(d: int) -> np.ndarray:
    """Where the finest segments of vectors of d components begin, and d."""
    n = 1
    while 2 * n <= min(SEGMENTS, d):
        n *= 2
    return np.arange(n + 1) * d // n


def summarise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    edges = segment_edges(m.shape[1])
    parts = [m[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    if not m.shape[1]:
        return np.zeros((len(m), 1)), np.zeros((len(m), 1))
    return np.stack([p.mean(1) for p in parts], 1), np.stack([p.std(1) for p in parts], 1)


def levels(means: np.ndarray, deviations: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the whole vector to the finest segments: (mean, deviation) of each, either times the root of the segment's size. Deviations
    are widened by what rounding may have taken off."""
    size = np.diff(segment_edges(d)).astype(float)
    total, squares = means * size, (deviations**2 + means**2) * size
    out = []
    while True:
        root = np.sqrt(np.maximum(size, 1))
        out.append((total / root, np.sqrt(np.maximum(squares - (total / root) ** 2, 0) + 1e-12 * squares)))
        if len(size) == 1:
            return out[::-1]
        size, total, squares = size[::2] + size[1::2], total[:, ::2] + total[:, 1::2], squares[:, ::2] + squares[:, 1::2]


def exact_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers with one."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = float(np.abs(rows).max()) * float(np.abs(anchor).sum())
    if most < 2**53:
        return (rows @ anchor).astype(np.int64)
    if most >= 2**63:
        raise ValueError("SCORE_TOO_LARGE: an inner product may exceed 63 bits")
    return rows.astype(np.int64) @ anchor.astype(np.int64)


def kth_largest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k])


class _Side:
    """Rows of one group or anchors of one block."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.n, self.ids, self.labels = (pdf[c].to_numpy() for c in ("n", "vec_id", "label"))
        self.d = int(pdf["d"].iloc[0])
        self.m = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(len(pdf), self.d)
        summary = np.frombuffer(b"".join(pdf["summary"]), np.float64).reshape(len(pdf), 2, -1)
        self.levels = levels(summary[:, 0], summary[:, 1], self.d)

    def bounds(self, level: int, at: np.ndarray, other: _Side, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest scores that rows ``at`` may have with row i of another side."""
        (mean, deviation), (mean_i, deviation_i) = self.levels[level], other.levels[level]
        middle, half = mean[at] @ mean_i[i], deviation[at] @ deviation_i[i]
        lengths = np.hypot(self.levels[0][0][at, 0], self.levels[0][1][at, 0]) * np.hypot(other.levels[0][0][i, 0], other.levels[0][1][i, 0])
        half = half + 1e-9 * lengths + 0.5  # rounding of the sums
        return middle - half, middle + half


def best_of(rows: _Side, anchors: _Side, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best other rows of an anchor's label."""
    at = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.n != anchors.n[i]))
    for level in range(len(rows.levels)):
        if len(at) <= k:
            break
        low, high = rows.bounds(level, at, anchors, i)
        at = at[high >= kth_largest(low, k)]
    score = exact_scores(rows.m[at], anchors.m[i])
    order = np.lexsort((rows.ids[at], -score))[:k]
    return at[order], score[order]


def window_of(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def best_in_windows(rows: _Side, anchors: _Side, i: int, positives: list[int], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(positive score, places, scores) of the k best rows of other labels in each positive's window."""
    windows = [(p, *window_of(p)) for p in sorted(set(positives)) if p >= 0]  # below zero the window is empty
    at = np.flatnonzero(rows.labels != anchors.labels[i])
    for level in range(len(rows.levels)):
        if len(at) <= k:
            break
        low, high = rows.bounds(level, at, anchors, i)
        stays = np.zeros(len(at), bool)
        for _, least, most in windows:
            touches = (high >= least) & (low <= most)
            inside = low[(low >= least) & (high <= most)]
            stays |= touches & (high >= kth_largest(inside, k)) if len(inside) >= k else touches
        at = at[stays]
    score = exact_scores(rows.m[at], anchors.m[i])
    out = []
    for p, least, most in windows:
        here = np.flatnonzero((score >= least) & (score <= most))
        here = here[np.lexsort((rows.ids[at[here]], -score[here]))[:k]]
        out.append((p, at[here], score[here]))
    return out


def clean(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """n (a row's number), vec_id, label, is_anchor, d, vec (whole numbers as doubles) and summary of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            edges, flat = lists.offsets.to_numpy(), np.floor(256 * lists.values.to_numpy(zero_copy_only=False))
            sizes = np.diff(edges)
            vecs, summaries = [b""] * b.num_rows, [b""] * b.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                m = flat[edges[at][:, None] + np.arange(d)]
                both = np.stack(summarise(m), 1)
                for k, row, s in zip(at.tolist(), m, both, strict=True):
                    vecs[k], summaries[k] = row.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int32()), pa.array(vecs, pa.binary()), pa.array(summaries, pa.binary())], names=["vec_id", "label", "is_anchor", "d", "vec", "summary"])

    packed = rows.mapInArrow(pack, "vec_id long, label long, is_anchor boolean, d int, vec binary, summary binary")
    return materialize(packed.withColumn("n", F.monotonically_increasing_id()), "vectors")


def _grouped(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows sorted by length and label, numbered into groups (a column ``name``) of at most ``most``."""
    return numbered(rows, ["d", "label", "n"]).withColumn(name, F.floor(F.col("position") / most)).drop("position")


def _meetings(blocks: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """block, g: which block meets which groups. Groups are in the order of their keys: those of a key follow each other."""
    reach = groups.groupBy(*keys).agg(F.min("g").alias("first"), F.max("g").alias("last"))
    return materialize(blocks.join(reach, keys).select("block", F.explode(F.sequence("first", "last")).alias("g")).distinct(), "pairs")


def _met(rows: DataFrame, asked: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d in set(left["d"]) & set(right["d"]):
            group, block = _Side(left[left["d"] == d]), _Side(right[right["d"] == d])
            out += work(group, block, right[right["d"] == d])
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame({c: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k, c in enumerate(columns)})

    return rows.join(pairs, "g").groupBy("g", "block").cogroup(asked.join(pairs, "block").groupBy("g", "block")).applyInPandas(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where ``is_anchor`` holds and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels in the positive's window."""
    rows = clean(vectors, is_anchor, id_col, vector_col, label)
    groups = materialize(_grouped(rows.drop("is_anchor"), group_rows, "g"), "groups")
    anchors = materialize(_grouped(rows.where("is_anchor").drop("is_anchor"), block_anchors, "block"), "anchors")
    labels_of_blocks = anchors.select("block", "d", "label").distinct()

    def find_positives(group: _Side, block: _Side, _: pd.DataFrame) -> list[tuple]:
        out = []
        for i in range(len(block.n)):
            at, score = best_of(group, block, i, positives)
            out.append((np.full(len(at), block.n[i]), np.full(len(at), block.ids[i]), group.ids[at], score))
        return out

    same = _meetings(labels_of_blocks, groups, ["d", "label"])
    found = _met(groups, anchors, same, find_positives, "n long, anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("n").orderBy(F.desc("positive_score"), "positive_id")
    chosen = materialize(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).drop("place"), "positives")
    asked = anchors.join(chosen.groupBy("n").agg(F.collect_set("positive_score").alias("positives")), "n")

    def find_negatives(group: _Side, block: _Side, asked: pd.DataFrame) -> list[tuple]:
        out = []
        for i, scores in enumerate(asked["positives"]):
            for p, at, score in best_in_windows(group, block, i, [int(s) for s in scores], negatives):
                out.append((np.full(len(at), block.n[i]), np.full(len(at), p), group.ids[at], score))
        return out

    others = _meetings(labels_of_blocks.select("block", "d").distinct(), groups, ["d"])
    found = _met(groups, materialize(asked, "asked"), others, find_negatives, "n long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("n", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(ranked, ["n", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
