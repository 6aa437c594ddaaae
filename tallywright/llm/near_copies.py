"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's set: A-Z lower-cased, words split at ASCII white space, shingles of five words (a shorter text is one shingle, a text without
words has the empty set). Its SimHash has 512 bits: a bit is set where over half of the set's hashes have it (where just half do, a
constant decides). Two sets at 0.8 have a cosine of 8/9 at least, so that a bit differs with probability 0.152 at most. A pair is looked
at if at most ``NEAR_BITS`` differ, and what is looked at is verified by its exact similarity.

Pieces of the SimHash are keys; texts that share one are a bucket. Keys are short and few, 29 to 32 for any number of texts up to 16
million texts (``shape``), so that what is shuffled grows with the texts. A bucket of many texts is searched in its task by further
pieces, longer ones in larger buckets (``_parts``), so that the comparisons of a text don't grow with the bucket. A pair at 0.8 that
shares a key is met there 97 times of 100, and keys are as many that it is overlooked once in a hundred thousand (that holds for
sets large enough for a normal sum; of sets of four and five shingles, where a bit differs with 0.1875, one pair in a thousand).

Work is on distinct sets. First each text that has others close by in its bucket is verified against the least of them, in rows that grow
with the bucket only. Pairs that are still close by without being linked are verified as such where a bucket has few of them. Where it
has many, only what they connect is written; these crowds, of all buckets together, are cut into blocks of bounded size, and every two
blocks are compared pair by pair in a group of their own, leaving out pairs that are linked already or not close. A group holds the texts
of one block, and up to ``MOST_BLOCKS`` blocks of ``BLOCK_BYTES`` a text is sent a fixed number of times at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import simhash
from tallywright.llm.common import kept, materialize, narrow, text_or_empty
from tallywright.llm.components import connected_components

SIZE = 5
MEASURED, NEAR_BITS = 512, 129  # bits that measure distance; a pair at 0.8 differs in 77.5 of them, with a deviation of 8.1
OVERLOOKED, COSINE = 1e-5, 8 / 9  # of pairs at 0.8, at most; their cosine, at least
DIFFER, MET = math.acos(COSINE) / math.pi, 0.97  # a bit of such a pair differs; it is met in a bucket that it shares
FIRST_BITS = 25  # of the first long: 9.7 bits differ at 0.8, with a deviation of 2.9
WHOLE, PART, LONG = 512, 32, 128  # texts of a bucket that is searched whole, of a part of others (about), of a part that is searched by itself
PAIRS = 4  # for each text of a bucket, at most, are verified as such
BLOCK, BLOCK_BYTES, MOST_BLOCKS = 256, 16_000_000, 16
WORDS = [f"s{k}" for k in range(MEASURED // 64)]
MOST_WORDS = 200_000
_U = np.uint64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SIZE)], _U)
_MOST_BITS = 64 * 64
_SALTS = np.random.default_rng(17).integers(1 << 63, size=_MOST_BITS // 64, dtype=_U)
_TIES = np.random.default_rng(18).integers(2, size=_MOST_BITS).astype(bool)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Words(dict):
    """Hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 21)
        return h


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending."""
    words = text.encode("utf-8", "replace").lower().split()
    known = kept("shingles", _Words)
    if len(known) > MOST_WORDS:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), _U, len(words))
    size = min(SIZE, len(w))
    if not size:
        return w
    n = len(w) - size + 1
    total = np.full(n, size, _U)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += w[k : k + n] * _POWERS[k]
        return np.unique(_mixed(total))


def _rounds(bits: int) -> int:
    """Pieces of so many bits that are looked at for a pair to be met."""
    return math.ceil(math.log(1 - MET) / math.log(1 - (1 - DIFFER) ** bits))


def shape(texts: int) -> tuple[int, int]:
    """(bits of a key, number of keys) for so many texts: a bucket then holds at most 262,144 unrelated ones."""
    bits = min(16, max(6, texts.bit_length() - 18))
    piece = max(1, (texts >> bits) // PART).bit_length()
    agree = 1 - np.arange(MEASURED) / MEASURED  # by the number of bits in which a pair happens to differ
    odds = np.array([math.comb(MEASURED, d) * DIFFER**d * (1 - DIFFER) ** (MEASURED - d) for d in range(MEASURED)])
    missed = 1 - agree**bits * (1 - (1 - agree**piece) ** _rounds(piece))
    return bits, next(n for n in range(1, _MOST_BITS // bits) if odds @ missed**n <= OVERLOOKED)


def simhash_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """The set's SimHash of so many bits: whether over half of the shingles' hashes have each."""
    salts, total = _SALTS[: -(-bits // 64)], np.zeros(64 * -(-bits // 64), np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(cells), 255):  # sums of as many bits fit a byte
            hashes = _mixed(cells[a : a + 255, None] ^ salts)
            total += np.unpackbits(hashes.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    over = 2 * total[:bits] - len(cells)
    return (over > 0) | ((over == 0) & _TIES[:bits])


def keys(cells: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a set's SimHash the bits that measure distance, as longs, and ``n`` keys of ``bits`` bits."""
    simhash_of = simhash_bits(cells, max(MEASURED, bits * n))
    return np.packbits(simhash_of[:MEASURED]).view(np.int64), simhash_of[: bits * n].reshape(n, bits) @ (1 << np.arange(bits))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _with_keys(rows: DataFrame, bits: int, n: int) -> DataFrame:
    """doc_id, __th, text → doc_id, __th, fp (hash of the set), s0 to s7 (bits that measure distance), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in narrow(batches):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            prints = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U).view(np.int64)
            made = [keys(s, bits, n) for s in sets]
            words = [pa.array(np.array([m[0][k] for m in made], np.int64)) for k in range(len(WORDS))]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * n, pa.int32()), pa.array(np.concatenate([m[1] for m in made]), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64()), *words, listed], names=["doc_id", "__th", "fp", *WORDS, "keys"])

    longs = "".join(f"{s} long, " for s in WORDS)
    return rows.select("doc_id", "__th", text_or_empty("text").alias("text")).mapInArrow(run, f"doc_id long, __th long, fp long, {longs}keys array<int>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by band and key (the first two columns) → the columns of each bucket of two or more."""
    at, held = None, []

    def whole() -> list[list[np.ndarray]]:
        columns = held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held, strict=True)] if held else [()]
        return [columns] if len(columns[0]) > 1 else []

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        where = (columns[0].astype(np.int64) << 32) | columns[1].astype(np.int64)
        edges = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a or where[0] != at:
                yield from whole()
                held = []
            held.append([c[a:b] for c in columns])
        at = where[-1]
    yield from whole()


def _distance(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """In how many bits the texts of x differ from those of y, given as arrays of longs."""
    out = np.zeros(np.broadcast_shapes(x[0].shape, y[0].shape), np.uint16)
    for a, b in zip(x, y, strict=True):
        out += np.bitwise_count((a ^ b).view(_U))  # of signed numbers the absolute value's bits are counted
    return out


def _close(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which texts of x are close to which of y."""
    near = np.bitwise_count((x[0][:, None] ^ y[0]).view(_U)) <= (FIRST_BITS if len(x) > 2 else 64)
    i, j = np.nonzero(near)
    near[i, j] = _distance([c[i] for c in x], [c[j] for c in y]) <= NEAR_BITS
    return near


def _parts(s: list[np.ndarray], turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, where parts begin and end) of a bucket's texts, several times: texts of a part agree in a piece of their bits. Any pair
    at 0.8 shares a part with probability ``MET``; other pieces are taken each ``turn``."""
    n = len(s[0])
    if n <= WHOLE:
        yield np.arange(n), np.array([0, n])
        return
    bits = min(16, (n // PART).bit_length())
    random = np.random.default_rng(turn)
    for _ in range(_rounds(bits)):
        piece = np.zeros(n, np.uint16)
        for at in random.choice(64 * len(s), bits, replace=False).tolist():
            piece = piece << 1 | (s[at // 64] >> (at % 64) & 1).astype(np.uint16)
        order = np.argsort(piece, kind="stable")
        yield order, np.concatenate([[0], np.flatnonzero(np.diff(piece[order])) + 1, [n]])


def _long_parts(order: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
    for k in np.flatnonzero(np.diff(edges) > LONG):
        yield order[edges[k] : edges[k + 1]]


def _close_pairs(s: list[np.ndarray], order: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The close pairs of all parts up to ``LONG``."""
    sizes = np.diff(edges)
    short = np.repeat(sizes <= LONG, sizes)
    order, part = order[short], np.repeat(np.arange(len(sizes)), sizes)[short]
    first, most = s[0][order].view(_U), FIRST_BITS if len(s) > 2 else 64
    mine, others = [order[:0]], [order[:0]]
    for k in range(1, int(sizes[sizes <= LONG].max(initial=0))):
        at = np.flatnonzero((np.bitwise_count(first[:-k] ^ first[k:]) <= most) & (part[:-k] == part[k:]))
        mine.append(order[at])
        others.append(order[at + k])
    i, j = np.concatenate(mine), np.concatenate(others)
    near = _distance([c[i] for c in s], [c[j] for c in s]) <= NEAR_BITS
    return i[near], j[near]


def _partners_in_long(rows: np.ndarray, s: list[np.ndarray], found: np.ndarray) -> None:
    """Where most are close to a few texts, these are compared with them only."""
    left = rows
    while len(left) > BLOCK:
        near = np.flatnonzero(_close([c[left[:1]] for c in s], [c[left] for c in s])[0])
        if 8 * len(near) < len(left):
            break
        found[left[near[1:]]] = np.minimum(found[left[near[1:]]], left[0])
        if len(near) > 1:
            found[left[0]] = min(found[left[0]], left[near[1]])
        left = np.delete(left, near)
    left = left[found[left] == len(found)]
    for a in range(0, len(left), BLOCK):
        some = left[a : a + BLOCK]
        for b in range(0, len(rows), 4096):
            others = rows[b : b + 4096]
            near = _close([c[some] for c in s], [c[others] for c in s]) & (some[:, None] != others)
            hit = near.any(1)
            found[some[hit]] = np.minimum(found[some[hit]], others[near[hit].argmax(1)])


def partners(s: list[np.ndarray], turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions, positions of another one close by) of all texts of a bucket that have any; mostly the first of those close by."""
    n = len(s[0])
    found = np.full(n, n)
    for order, edges in _parts(s, turn):
        for rows in _long_parts(order, edges):
            _partners_in_long(rows, s, found)
        i, j = _close_pairs(s, order, edges)
        np.minimum.at(found, i, j)
        np.minimum.at(found, j, i)
    mine = np.flatnonzero(found < n)
    return mine, found[mine]


class _Found:
    """Pairs of a bucket's ``n`` texts, each once, while they are at most ``PAIRS`` for each text; of more, only what they connect."""

    def __init__(self, n: int) -> None:
        self.n, self.group = n, np.arange(n)  # of each text, the place of its group's first
        self.pairs: np.ndarray | None = np.zeros(0, np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.pairs is not None:
            self.pairs = np.union1d(self.pairs, np.minimum(i, j) * self.n + np.maximum(i, j))
            if len(self.pairs) > PAIRS * self.n:
                self._connect(*np.divmod(self.pairs, self.n))
                self.pairs = None
        else:
            self._connect(i, j)

    def _connect(self, i: np.ndarray, j: np.ndarray) -> None:
        group = self.group
        while (differ := group[i] != group[j]).any():
            a, b = group[i[differ]], group[j[differ]]
            np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
            while (group[group] != group).any():
                group[:] = group[group]


def apart(root: np.ndarray, s: list[np.ndarray], turn: int = 0, into: _Found | None = None) -> np.ndarray:
    """Positions of the texts of a bucket that have another one close by which they are not linked with. ``into`` takes the pairs."""
    hit = np.zeros(len(root), bool)
    into = into or _Found(len(root))
    for order, edges in _parts(s, turn):
        for rows in _long_parts(order, edges):
            roots, counts = np.unique(root[rows], return_counts=True)
            strangers = rows[root[rows] != roots[counts.argmax()]]  # to the largest group; its texts are compared with them only
            for a in range(0, len(strangers), BLOCK):
                some = strangers[a : a + BLOCK]
                for b in range(0, len(rows), 4096):
                    others = rows[b : b + 4096]
                    i, j = np.nonzero(_close([c[some] for c in s], [c[others] for c in s]) & (root[some][:, None] != root[others]))
                    hit[some[i]] = hit[others[j]] = True
                    into.add(some[i], others[j])
        i, j = _close_pairs(s, order, edges)
        other = root[i] != root[j]
        hit[i[other]] = hit[j[other]] = True
        into.add(i[other], j[other])
    return np.flatnonzero(hit)


def _gathered(found: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of many small finds in batches."""
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    for columns in found:
        if len(columns[0]):
            held.append(columns)
            n += len(columns[0])
        if n >= 10_000:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def _one_close_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, key, fp, bits sorted by bucket → fp, other: a text close by for each that has any."""

    def found() -> Iterator[list[np.ndarray]]:
        for band, _, fp, *s in _buckets(batches):
            mine, others = partners(s, band[0])
            yield [fp[mine], fp[others]]

    return _gathered(found(), ["fp", "least"])


def _open_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, key, fp, root, bits sorted by bucket → fp, other, crowded: close ones that are not linked. Where they are too many as pairs,
    each text with the first of those that it is connected with through them (crowded)."""

    def found() -> Iterator[list[np.ndarray]]:
        for band, _, fp, root, *s in _buckets(batches):
            into = _Found(len(fp))
            at = apart(root, s, band[0], into)
            crowded = into.pairs is None
            i, j = (at, into.group[at]) if crowded else np.divmod(into.pairs, len(fp))
            yield [fp[i], fp[j], np.full(len(i), crowded)]

    return _gathered(found(), ["fp", "other", "crowded"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, text of a, text of b → a, b of the pairs that are near."""
    for batch in narrow(batches):
        near = [alike(shingles(s), shingles(t)) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


class _Bucket:
    """The texts of two blocks as they come. Those of the first (side 0) are held, and every text is compared with the held ones that are
    close to it and that it is not linked with yet."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.fps: list[int] = []  # of held texts, as the lists below
        self.texts: list[str] = []
        self.sets: dict[int, np.ndarray] = {}  # of those that were asked for, by place
        self.bits = np.zeros((BLOCK, len(WORDS)), np.int64)

    def _root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _set(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = shingles(self.texts[k])
        return self.sets[k]

    def add(self, side: int, fp: int, root: int, bits: np.ndarray, text: str) -> list[tuple[int, int]]:
        self.parent[fp] = self._root(root)
        n, cells, out = len(self.fps), None, []
        far = np.bitwise_count((self.bits[:n] ^ bits).view(_U)).sum(1, dtype=np.uint16)
        near = np.flatnonzero(far <= NEAR_BITS)
        for k in near[np.argsort(far[near], kind="stable")].tolist():  # once the closest is linked, the others of its group are
            mine, other = self._root(fp), self._root(self.fps[k])
            if mine != other:
                cells = shingles(text) if cells is None else cells
                if alike(cells, self._set(k)):
                    out.append((fp, self.fps[k]))
                    self.parent[other] = mine
        if side == 0:
            if n == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[n] = bits
            self.fps.append(fp)
            self.texts.append(text)
        return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """band, key, i, j, side, fp, root, bits, text sorted by bucket, blocks and side → links that are missing."""
    at, bucket = None, _Bucket()
    for batch in narrow(batches):
        found: list[tuple[int, int]] = []
        bits = np.stack([c.to_numpy() for c in batch.columns[7:-1]], 1)
        for n, (band, key, i, j, side, fp, root, text) in enumerate(zip(*[c.to_pylist() for c in [*batch.columns[:7], batch.columns[-1]]], strict=True)):
            if (band, key, i, j) != at:
                at, bucket = (band, key, i, j), _Bucket()
            found += bucket.add(side, fp, root, bits[n], text)
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])


def in_blocks(rows: DataFrame) -> DataFrame:
    """band, key, fp, root, bytes → band, key, i, j, side, fp, root: every two blocks of a bucket (and each block with itself) meet in a
    group of their own. A block holds about ``BLOCK`` texts, more where these were over ``MOST_BLOCKS`` blocks, but ``BLOCK_BYTES`` at most:
    rows grow with the bucket, until its texts exceed ``MOST_BLOCKS`` times ``BLOCK_BYTES``."""
    few = F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(MOST_BLOCKS))
    sizes = rows.groupBy("band", "key").agg(F.greatest(few, F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    placed = rows.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return met.select("band", "key", i.alias("i"), j.alias("j"), F.when(F.col("block") == i, 0).otherwise(1).alias("side"), "fp", "root")


def _by_bucket(prints: DataFrame, *columns: str) -> DataFrame:
    """A row per text and key, buckets together."""
    rows = prints.select("fp", *columns, *WORDS, F.posexplode("keys").alias("band", "key")).select("band", "key", "fp", *columns, *WORDS)
    return rows.repartition("band", "key").sortWithinPartitions("band", "key", "fp")


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (fp, least), held (fp, text) → a, b of those that are near."""
    sides = pairs.join(held.select("fp", "text"), "fp").join(held.select(F.col("fp").alias("least"), F.col("text").alias("other")), "least")
    return sides.select(F.col("fp").alias("a"), F.col("least").alias("b"), "text", "other").mapInArrow(_judge, "a long, b long")


def near_links(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """prints (fp, __th, bits, keys), texts (__th, text) → links (a, b) that connect all sets found near, none between others."""
    sets = prints.dropDuplicates(["fp"])
    pairs = _by_bucket(sets).mapInArrow(_one_close_by, "fp long, least long")
    pairs = materialize(pairs.select(F.greatest("fp", "least").alias("fp"), F.least("fp", "least").alias("least")).distinct(), "pairs")
    wanted = materialize(pairs.select("fp").unionByName(pairs.select(F.col("least").alias("fp"))).distinct(), "wanted")
    classes = prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(*[F.min(c).alias(c) for c in ("__th", *WORDS)])
    held = materialize(texts.join(classes, "__th").select("fp", *WORDS, "text", F.octet_length("text").alias("bytes")).dropDuplicates(["fp"]), "texts")
    links = materialize(_verified(pairs, held), "links")
    roots = connected_components(links).withColumnRenamed("node", "fp")
    rooted = sets.join(wanted, "fp", "left_semi").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    opened = materialize(_by_bucket(rooted, "root").mapInArrow(_open_ones, "fp long, other long, crowded boolean"), "opened")
    few = opened.where(~F.col("crowded")).select(F.greatest("fp", "other").alias("fp"), F.least("fp", "other").alias("least"))
    few = _verified(few.distinct().join(pairs, ["fp", "least"], "left_anti"), held)
    crowds = connected_components(opened.where("crowded").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    crowds = rooted.select("fp", "root").join(crowds.select(F.col("node").alias("fp"), F.lit(0).alias("band"), F.col("root").alias("key")), "fp")
    left = in_blocks(crowds.join(held.select("fp", "bytes"), "fp")).join(held.select("fp", *WORDS, "text"), "fp")
    blocks = ["band", "key", "i", "j"]
    left = left.select(*blocks, "side", "fp", "root", *WORDS, "text").repartition(*blocks).sortWithinPartitions(*blocks, "side", "fp")
    more = left.mapInArrow(_compare, "a long, b long")
    return links.unionByName(few).unionByName(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, chosen as by ``simhash.keep_one``."""

    def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        prints = materialize(_with_keys(rows, *shape(docs.count())), "prints")
        return prints.select("doc_id", "__th", "fp"), near_links(prints, rows.select("__th", text_or_empty("text").alias("text")))

    return simhash.one_of_each_group(docs, linked, id_col, text_col)
