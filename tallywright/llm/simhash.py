"""SimHash near-duplicates with covering locality-sensitive hashing.

A text's fingerprint: A-Z lower-cased, words split at ASCII white space, shingles of three words joined by blanks (repeats count; a
shorter text is one shingle), each hashed with XXH64, seed 42; a bit is set where over half the hashes have it. A text without words
has fingerprint zero.

Fingerprints link at a Hamming distance of at most r = 3. Each bit position gets a nonzero vector of r + 1 bits; for each of the
2^(r+1) - 1 nonzero vectors v, a table keeps the bits whose vector has odd inner product with v. At most r differing positions span
less than the whole space, so some v is orthogonal to all of them: in that table the two fingerprints agree. No pair is missed.

Work is on distinct fingerprints. A bucket's fingerprints are compared in blocks and only a spanning forest of its links leaves the
task. Buckets of over ``HOT`` fingerprints are keyed once more, by covering masks over the bits the first mask left free. What then
shares a bucket differs in at most 16 bits, so that a bucket holds at most 65,536 distinct fingerprints however large the corpus; it is
compared in blocks of bounded memory. Components come from large-star / small-star rounds over the links.

Defined results: null and empty texts have fingerprint zero and are linked with each other like any other; repeated rows share a
fingerprint and component; a component's id is its smallest non-null doc_id (null if it has none); null ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import kept, materialize, narrow, text_or_empty
from tallywright.llm.components import connected_components

RADIUS = 3
HOT = 1024
_U = np.uint64


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    stops = ends[words - 1 :].tolist()
    for a in range(0, n, 1 << 16):
        part = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed long named ``out``."""
    others = [f for f in df.schema if f.name not in (out, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("simhash", dict)
        for b in narrow(batches):
            prints = np.array([fingerprint(t) for t in b.column(b.num_columns - 1).to_pylist()], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints, pa.int64())], names=[*[f.name for f in others], out])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return df.select(*[F.col(f"`{f.name}`") for f in others], text_or_empty(text_col).alias("__text")).mapInArrow(run, f"{kinds}`{out}` long")


def covering_masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the bit positions ``free``: for any ``radius`` of them, some mask has none."""
    width = radius + 1
    vectors = {bit: 1 + k % ((1 << width) - 1) for k, bit in enumerate(free)}
    return [sum(1 << bit for bit in free if bin(vectors[bit] & v).count("1") % 2) for v in range(1, 1 << width)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints."""
    n, parent, out = len(fp), list(range(len(fp))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(0, n, 512):
        rows = fp[a : a + 512]
        for b in range(a, n, 4096):
            near = np.bitwise_count(rows[:, None] ^ fp[None, b : b + 4096]) <= radius
            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = a + int(i), b + int(j)
                if x < y and (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
    return out


def _compare(radius: int):
    """Streams rows sorted by bucket; emits each bucket's forest. A bucket that spans batches is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_key, left_fp = None, []

        def close(found: list[tuple[int, int]]) -> None:
            if left_fp and (len(left_fp) > 1 or len(left_fp[0]) > 1):
                fp = np.concatenate(left_fp)
                found += [(int(fp[i]), int(fp[j])) for i, j in _links(fp.view(_U), radius)]

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
            fp, found = batch.column(3).to_numpy(), []
            if not len(fp):
                continue
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(fp)]])
            multiple = np.flatnonzero(np.diff(edges) > 1)
            first, last = tuple(keys[0]), tuple(keys[-1])
            if first != left_key:
                close(found)
                left_fp = []
            if len(edges) == 2:
                left_key, left_fp = first, [*left_fp, fp]
            else:
                left_fp.append(fp[: edges[1]])
                close(found)
                for k in multiple:
                    if 0 < k < len(edges) - 2:
                        part = fp[edges[k] : edges[k + 1]]
                        found += [(int(part[i]), int(part[j])) for i, j in _links(part.view(_U), radius)]
                left_key, left_fp = last, [fp[edges[-2] :]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = []
        close(found)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect whatever lies within ``radius``, none between others."""

    def keyed(rows: DataFrame, trail: str, masks: list[int]) -> DataFrame:
        """A row per mask: ``trail`` grows by the table's number, ``key`` is the part that the fingerprints agree in."""
        tables = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("t"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks)]))
        return rows.select("fp", *([c for c in rows.columns if c != "fp"]), tables.alias("__m")).select("fp", F.expr(trail).alias("trail"), F.col("__m.m").alias("mask"), F.col("fp").bitwiseAND(F.col("__m.m")).alias("key"))

    level = keyed(prints.select("fp"), "__m.t", covering_masks(list(range(64)), radius)).withColumn("upper", F.lit(0).cast("long"))
    found = None
    first = covering_masks(list(range(64)), radius)
    for depth in (0, 1):
        crowded = level.groupBy("trail", "upper", "key").count().where(F.col("count") > hot)
        crowded = materialize(crowded.select("trail", "upper", "key"), "crowded")
        some = crowded.limit(1).count() > 0
        calm = level.join(crowded, ["trail", "upper", "key"], "left_anti") if some and depth == 0 else level
        ordered = calm.select("trail", "upper", "key", "fp").repartition("trail", "upper", "key").sortWithinPartitions("trail", "upper", "key", "fp")
        part = ordered.mapInArrow(_compare(radius), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not some or depth:
            break
        busy = level.join(crowded, ["trail", "upper", "key"], "left_semi").select("fp", F.col("trail").alias("t0"), F.col("key").alias("upper"))
        pieces = None
        for k, mask in enumerate(first):
            again = covering_masks([bit for bit in range(64) if not mask >> bit & 1], radius)
            rows = busy.where(F.col("t0") == k)
            tables = F.explode(F.array(*[F.struct(F.lit(16 + 16 * k + t).cast("long").alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(again)]))
            rows = rows.select("fp", "upper", tables.alias("__m")).select("fp", F.col("__m.t").alias("trail"), F.col("__m.m").alias("mask"), F.col("fp").bitwiseAND(F.col("__m.m")).alias("key"), "upper")
            pieces = rows if pieces is None else pieces.unionByName(rows)
        level = materialize(pieces, "rekeyed")
    return found.distinct()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = materialize(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = materialize(near_links(classes, radius), "links")
    roots = connected_components(links)  # node, root: fingerprints with links only
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialize(rooted.join(named, "root").select("fp", "component_id"), "members")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id (a null id last), of equal ids the one with the
    smallest text hash, of equal rows any one. Rows of groups with one member stay as they are."""

    def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        prints = materialize(with_fingerprints(rows), "prints")
        return prints, near_links(prints.select("fp").distinct(), radius)

    return one_of_each_group(docs, linked, id_col, text_col)


def one_of_each_group(docs: DataFrame, linked: Callable[[DataFrame], tuple[DataFrame, DataFrame]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``keep_one`` keeps, for any fingerprint: ``linked`` turns rows (doc_id, __th, text) into prints (doc_id, __th, fp) and
    links (a, b) of fingerprints."""
    hashed = docs.withColumn("__th", F.xxhash64(F.lit(5), text_or_empty(text_col)))
    prints, links = linked(hashed.select(F.col(id_col).cast("long").alias("doc_id"), "__th", F.col(text_col).alias("text")))
    classes = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__th")).alias("one"), F.count(F.lit(1)).alias("n"))
    links = materialize(links, "links")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    groups = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("one").alias("one"), F.sum("n").alias("n"))
    keepers = materialize(groups.select(F.col("one.doc_id").alias("__id"), F.col("one.__th").alias("__t")).distinct(), "keepers")
    match = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t"))
    # a kept row that is repeated stays once: its copies are told apart by a number within the key
    several = prints.groupBy("doc_id", "__th").count().where(F.col("count") > 1).select(F.col("doc_id").alias("__id"), F.col("__th").alias("__t"))
    several = materialize(several, "several")
    once = hashed.join(keepers, match, "left_semi")
    if several.limit(1).count() == 0:
        return once.drop("__th")
    single = once.join(several, match, "left_anti")
    again = once.join(several, match, "left_semi").dropDuplicates([id_col, "__th"])
    return single.unionByName(again).drop("__th")
