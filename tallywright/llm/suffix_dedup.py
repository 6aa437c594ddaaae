"""Exact substring removal by a sparse, distributed suffix sort.

What lies in a window that starts anywhere else too, in any document, is removed. A window is a string of ``length`` bytes, or a run
of so many whole words with the white space between them. Sorting the suffixes of all positions would do; most can be left out. Each
window picks the least hash among its grams (64 bytes, or 8 words), leftmost first: an anchor that depends on the window's content
alone, so equal windows have equal anchors at equal offsets. The windows of one anchor are neighbours, a cell. Then:

1. Anchors whose hash occurs once hold no repeat and go. Equal cells become one, with their number (told by 128-bit hashes).
2. The suffixes that start at the anchors of the cells left are sorted in each task into runs, front-coded (the prefix shared with the
   one before is not sent again), exchanged by anchor and merged by loser trees that carry common-prefix lengths, so that no known
   prefix is compared again. The merged order and its prefix lengths, with the same for the reversed text left of the anchors, say
   exactly which windows of a cell occur in another; of a cell that occurs twice all do.
3. Cells that crowd at one anchor (over ``HOT`` different ones) are not gathered. Their texts go through the same steps with longer
   grams, which part them by the bytes next to the anchor; the last gram is a whole window, at which no two different cells meet.

Spans return to documents by content (a 128-bit hash of the text). Defined results: null and empty texts have no bytes; matches never
cross documents; repeated rows are each other's repeats; windows are judged on the input; lengths are bytes of UTF-8; words are parted
by ASCII white space.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import kept, materialize, narrow, text_or_empty
from tallywright.staging import scope, shared_folder

LENGTH = 400
SEGMENT = 1 << 18  # windows worked on at once
HOT, CELLS_PER_BUCKET = 2048, 20_000
MOST_SENT = 1_000_000  # text hashes sent to every task; beyond it all texts are shuffled
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(1).integers(1 << 63, size=256, dtype=_U)
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    n, inverse = SEGMENT + 1025, pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte substring: sum of byte values times powers, shifted to a common power, then mixed."""
    up, down = kept("powers", _power_tables)
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
        return _mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def _word_hashes(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over stretches of bytes that the tables of powers cover."""
    (up, down), data, a = kept("powers", _power_tables), np.frombuffer(raw, np.uint8), 0
    out = np.empty(len(starts), _U)
    with np.errstate(over="ignore"):
        while a < len(starts):
            s = starts[a]
            b = int(np.searchsorted(stops, s + SEGMENT, "right"))
            if b == a:  # a word beyond the tables
                out[a] = xxhash.xxh64_intdigest(raw[s : stops[a]], 23)
                a += 1
                continue
            n = int(stops[b - 1] - s)
            sums = np.zeros(n + 1, _U)
            np.cumsum(_BYTES[data[s : s + n]] * up[:n], out=sums[1:])
            out[a:b] = _mixed((sums[stops[a:b] - s] - sums[starts[a:b] - s]) * down[starts[a:b] - s])
            a = b
    return out


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and where it stops."""
    inside = np.concatenate([[False], ~_BLANK[np.frombuffer(raw, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: running minima from both ends of blocks."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchored(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows (of ``width`` grams) with one anchor: the anchor's place, the first and the last window."""
    low = _U((1 << 24) - 1)
    at = (_sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=_U), width) & low).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
    return at[edges[:-1]], edges[:-1], edges[1:] - 1


@dataclass(frozen=True)
class Windows:
    """Strings of ``size`` bytes, or of ``size`` words."""

    size: int
    words: bool = False

    def grams(self) -> list[int]:
        least = min(8 if self.words else 64, self.size)
        return sorted({least, self.size - (self.size - least) // 8, self.size})

    @property
    def least_bytes(self) -> int:
        return 2 * self.size - 1 if self.words else self.size

    def cells(self, raw: bytes, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays of (hash of the anchor's gram, where the anchor, the first window and the end of the last window are) of cells."""
        width = self.size - gram + 1
        if self.words:
            starts, stops = word_bounds(raw)
            if len(starts) < self.size:
                return
            h = _word_hashes(raw, starts, stops)
            with np.errstate(over="ignore"):
                total = np.zeros(len(h) - gram + 1, _U)
                for k in range(gram):
                    total += h[k : k + len(total)] * _U(pow(_BASE, k + 1, 1 << 64))
                hashes = _mixed(total)
        windows = (len(h) if self.words else len(raw)) - self.size + 1
        for s in range(0, windows, SEGMENT):
            n = min(SEGMENT, windows - s)
            here = hashes[s : s + n + width - 1] if self.words else _gram_hashes(np.frombuffer(raw, np.uint8, n + self.size - 1, s), gram)
            at, first, last = _anchored(here, width)
            found = here[at].view(np.int64)
            at, first, last = at + s, first + s, last + s
            if self.words:
                at, first, last = starts[at], starts[first], stops[last + self.size - 1]
            else:
                last = last + self.size
            yield found, at, first, last

    def reaches(self, left: bytes, right: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Of the windows of a cell, by their offset (units left of the anchor): the least offset, bytes left and bytes right of the
        anchor. ``left`` is the cell's text before the anchor, reversed; ``right`` that from the anchor on."""
        if not self.words:
            offsets = np.arange(self.size - len(right), len(left) + 1)
            return self.size - len(right), offsets, self.size - offsets
        stops = word_bounds(right)[1]
        starts = np.concatenate([[0], word_bounds(left)[1]])
        least = self.size - len(stops)
        return least, starts[least:], stops[::-1][: len(starts) - least]


def _cells(windows: Windows, gram: int):
    """Texts → their cells, told by a hash of their bytes and of where the anchor lies in them."""
    names, digest = ["anchor", "c0", "c1", "u0", "u1", "at", "before", "after", "copies"], xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in narrow(batches):
            of, columns, marks = [], [], []
            for k, raw in enumerate(b.column(3).to_pylist()):
                for anchor, at, first, stop in windows.cells(raw, gram):
                    before = at - first
                    marks += [digest(raw[x:y], z) for x, y, z in zip(first.tolist(), stop.tolist(), before.tolist(), strict=True)]
                    columns.append((anchor, at, before, stop - at))
                    of.append(np.full(len(at), k))
            rows = np.concatenate(of) if of else np.zeros(0, np.int64)
            anchor, at, before, after = (np.concatenate([c[k] for c in columns]).astype(np.int64) if columns else np.zeros(0, np.int64) for k in range(4))
            cell = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            u0, u1, copies = (b.column(k).to_numpy()[rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (anchor, cell[:, 0], cell[:, 1], u0, u1, at, before, after, copies)], names=names)

    return run


# --- sorted runs ---------------------------------------------------------------------------------------------------------------
# An entry is (key, left, cell, many): key = anchor hash (8 bytes, big-endian) + text from the anchor on, left = text before the
# anchor, reversed, cell = its hash, many = whether it occurs twice or more.

_HEAD = struct.Struct("<IIIqq?")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, at least ``known``."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = np.frombuffer(a, np.uint8, n - known, known) != np.frombuffer(b, np.uint8, n - known, known)
    return known + int(x.argmax())


def front_code(entries: list[tuple]) -> bytes:
    """Sorted entries as one run; each key without the prefix it shares with the key before."""
    out, before = [], b""
    for key, left, cell, many in entries:
        h = common_prefix(before, key)
        tail = key[h:]
        out += [_HEAD.pack(h, len(tail), len(left), *cell, many), tail, left]
        before = key
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, tuple]]:
    """(prefix shared with the entry before, entry)."""
    at, key, size = 0, b"", _HEAD.size
    while at < len(run):
        h, tail, left, c0, c1, many = _HEAD.unpack_from(run, at)
        at += size
        key = key[:h] + run[at : at + tail]
        at += tail
        yield h, (key, run[at : at + left], (c0, c1), many)
        at += left


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """Merge sorted runs with a loser tree. A player carries the length of the prefix it shares with the last winner it met: of two
    players the longer one is the smaller, and only at equal lengths are bytes compared, from that length on."""
    streams = [read_run(r) for r in runs]
    k = 1
    while k < len(streams):
        k *= 2
    end = None  # an exhausted player; loses every game

    def pull(i: int):
        return next(streams[i], end) if i < len(streams) else end

    def play(a, b):
        """(winner, loser); players are [prefix, entry, stream] or None."""
        if a is None or b is None:
            return (a, b) if b is None else (b, a)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y, h = a[1][0], b[1][0], a[0]
        g = common_prefix(x, y, h)
        first = len(x) == g or (len(y) > g and x[g] < y[g])
        winner, loser = (a, b) if first else (b, a)
        loser[0] = g
        return winner, loser

    losers: list = [None] * (2 * k)
    row = []
    for i in range(k):
        got = pull(i)
        row.append(None if got is None else [0, got[1], i])
    level, base = row, k
    while len(level) > 1:
        base //= 2
        nxt = []
        for j in range(0, len(level), 2):
            w, loser = play(level[j], level[j + 1])
            losers[base + j // 2] = loser
            nxt.append(w)
        level = nxt
    winner = level[0]
    while winner is not None:
        yield winner[0], winner[1]
        i = winner[2]
        got = pull(i)
        player = None if got is None else [got[0], got[1], i]
        node = (k + i) // 2
        while node:
            player, losers[node] = play(player, losers[node])
            node //= 2
        winner = player


def _neighbours(shared: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Numbers [entry, offset], equal where two entries reach equally far (``reach``, -1 for not at all) and have the same text so
    far. ``shared``: prefix that each has in common with the one before, in sorted order."""
    inside = reach >= 0
    most = reach.max(0)
    out = np.cumsum(shared[:, None] < most[None, :], axis=0)
    odd = (inside & (reach != most)).any(0)
    for o in np.flatnonzero(odd):  # word windows of different lengths: each length has its own order of classes
        for k, r in enumerate(np.unique(reach[inside[:, o], o])):
            at = reach[:, o] == r
            out[at, o] = (np.cumsum(shared < r) + k * (len(shared) + 1))[at]
    return np.where(inside, out, -1)


def _runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _paired(entries: list[tuple], reaches: list[tuple], right: int, left: int) -> list[tuple[int, int, int, int]]:
    """``repeated_windows`` of two cells that have so many bytes in common on either side of the anchor."""
    (first, left_a, right_a), (second, left_b, right_b) = reaches
    low, high = max(first, second), min(first + len(left_a), second + len(left_b))
    if low >= high:
        return []
    left_a, right_a = left_a[low - first : high - first], right_a[low - first : high - first]
    left_b, right_b = left_b[low - second : high - second], right_b[low - second : high - second]
    runs = _runs_of((left_a == left_b) & (left_a <= left) & (right_a == right_b) & (right_a <= right))
    return [(*cell, int(left_a[b]), int(right_a[a])) for _, _, cell, many in entries if not many for a, b in runs]


def repeated_windows(entries: list[tuple], shared: list[int], windows: Windows) -> list[tuple[int, int, int, int]]:
    """Of one anchor's different cells, sorted, with the prefixes shared by neighbours: (cell, bytes left and right of the anchor) of each
    run of windows that occurs elsewhere too."""
    n = len(entries)
    out = [(*cell, len(left), len(key) - 8) for key, left, cell, many in entries if many]  # all of its windows: all of its text
    if n == 1 or len(out) == n:
        return out
    if n == 2 and not windows.words:
        right, left = shared[1] - 8, common_prefix(entries[0][1], entries[1][1])
        for key, before, cell, many in entries:
            a, b = max(windows.size - len(key) + 8, windows.size - right), min(len(before), left)
            if a <= b and not many:
                out.append((*cell, b, windows.size - a))
        return out
    # what reaches too little in common with any neighbour on both sides together is in no window of another's
    order = sorted(range(n), key=lambda i: entries[i][1])
    before = [0, *[common_prefix(entries[i][1], entries[j][1]) for i, j in zip(order[:-1], order[1:], strict=True)], 0]
    most_left = dict(zip(order, map(max, before[:-1], before[1:]), strict=True))
    most_right = [max(a, b) - 8 for a, b in zip([8, *shared[1:]], [*shared[1:], 8], strict=True)]
    kept_ones = [i for i in range(n) if most_right[i] + most_left[i] >= windows.least_bytes]
    if len(kept_ones) < 2:
        return out
    if len(kept_ones) < n:
        shared = [0, *[min(shared[a + 1 : b + 1]) for a, b in zip(kept_ones[:-1], kept_ones[1:], strict=True)]]
        entries, n = [entries[i] for i in kept_ones], len(kept_ones)
        order = sorted(range(n), key=lambda i: entries[i][1])
        before = [0, *[common_prefix(entries[i][1], entries[j][1]) for i, j in zip(order[:-1], order[1:], strict=True)], 0]
    reaches = [windows.reaches(left, key[8:]) for key, left, _, _ in entries]
    if n == 2:
        return out + _paired(entries, reaches, shared[1] - 8, before[1])
    least, stop = min(r[0] for r in reaches), max(r[0] + len(r[1]) for r in reaches)
    lefts, rights = np.full((n, stop - least), -1), np.full((n, stop - least), -1)
    for i, (first, left, right) in enumerate(reaches):
        lefts[i, first - least : first - least + len(left)] = left
        rights[i, first - least : first - least + len(left)] = right
    possible = np.where(rights < 0, 1 << 40, rights).min(0) <= max(shared[1:]) - 8  # offsets at which some two may agree
    if not possible.any():
        return out
    base = int(possible.argmax())
    lefts, rights = lefts[:, base:], rights[:, base:]
    right_class = _neighbours(np.array([0, *[s - 8 for s in shared[1:]]]), rights)
    left_class = np.empty_like(right_class)
    left_class[order] = _neighbours(np.array(before[:-1]), lefts[order])
    # number the classes of both sides together, offset by offset
    both = np.where(rights >= 0, right_class.astype(np.int64) * (int(left_class.max()) + 2) + left_class, -1 - np.arange(n)[:, None])
    rank = np.argsort(both, axis=0, kind="stable")
    ordered = np.take_along_axis(both, rank, 0)
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(both.shape, bool)
    again[1:] |= same
    again[:-1] |= same
    hit = np.empty_like(again)
    np.put_along_axis(hit, rank, again, 0)
    for i in np.flatnonzero(hit.any(1)):
        if not entries[i][3]:
            out += [(*entries[i][2], int(lefts[i, b]), int(rights[i, a])) for a, b in _runs_of(hit[i])]
    return out


def _merge_bucket(windows: Windows):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple] = []
        shared: list[int] = []
        for h, entry in merge_runs(list(pdf["run"])):
            if h < 8 and group:
                out += repeated_windows(group, shared, windows)
                group, shared = [], []
            group.append(entry)
            shared.append(h)
        if group:
            out += repeated_windows(group, shared, windows)
        return pd.DataFrame(out, columns=["c0", "c1", "left", "right"], dtype="int64")

    return merge


def _runs(n_buckets: int):
    """Texts with their cells → front-coded sorted runs, one per bucket and slice of a batch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in narrow(batches):
            entries: dict[int, list[tuple]] = {}
            for cells, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for c in cells:
                    at = c["at"]
                    key = struct.pack(">q", c["anchor"]) + raw[at : at + c["after"]]
                    entries.setdefault(c["anchor"] % n_buckets, []).append((key, raw[at - c["before"] : at][::-1], (c["c0"], c["c1"]), c["n"] > 1))
            names, runs = [], []
            for k, found in sorted(entries.items()):
                found.sort()
                names.append(k)
                runs.append(front_code(found))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(runs, pa.binary())], names=["bucket", "run"])

    return make


def _cell_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their cells → each cell as a text of its own."""
    for b in narrow(batches):
        out = [(c["c0"], c["c1"], c["n"], raw[c["at"] - c["before"] : c["at"] + c["after"]]) for cells, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in cells]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["u0", "u1", "copies", "raw"])


def _holding(texts: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame | None:
    """The texts whose hash is among the keys (a column u0), or not: told before the shuffle where the keys are at most MOST_SENT;
    None where they are more."""
    return texts.join(F.broadcast(keys), "u0", how) if keys.count() <= MOST_SENT else None


def _with_cells(texts: DataFrame, which: DataFrame) -> DataFrame:
    """(cells, raw): each text that a cell is taken from, read once however many documents hold it, with those cells."""
    per_text = which.groupBy("u0", "u1").agg(F.collect_list(F.struct("anchor", "c0", "c1", "at", "before", "after", "n")).alias("cells"))
    per_text = materialize(per_text, "per_text")
    held = _holding(texts, per_text.select("u0").distinct())
    one_each = (texts if held is None else held).select("u0", "u1", "raw").dropDuplicates(["u0", "u1"])
    return one_each.join(per_text, ["u0", "u1"]).select("cells", "raw")


def repeated_spans(texts: DataFrame, windows: Windows, grams: list[int] | None = None) -> DataFrame:
    """texts (u0, u1: hash; copies; raw) → (u0, u1, start, stop): spans of bytes to remove, which may overlap."""
    gram, *longer = grams or windows.grams()
    kinds = ", ".join(f"{c} long" for c in ("anchor", "c0", "c1", "u0", "u1", "at", "before", "after", "copies"))
    long_enough = texts.where(F.octet_length("raw") >= windows.least_bytes).select("u0", "u1", "copies", "raw")
    with scope(texts.sparkSession):  # of all cells, those that repeat stay
        cells = materialize(long_enough.mapInArrow(_cells(windows, gram), kinds), "cells")
        # written, so that the join has an exchange on either side and may be split where one anchor has many rows
        shared = materialize(cells.groupBy("anchor").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("anchor"), "shared")
        repeated = materialize(cells.join(shared, "anchor", "left_semi"), "repeated", outer=True)
    place = ["u0", "u1", "at", "before", "after"]
    distinct = repeated.groupBy("anchor", "c0", "c1").agg(F.sum("copies").alias("n"), F.min(F.struct(*place)).alias("one"))
    distinct = materialize(distinct.select("anchor", "c0", "c1", "n", "one.*"), "distinct")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") > HOT).select("anchor")
    any_crowded = bool(longer) and crowded.limit(1).count() > 0
    crowded = materialize(crowded, "crowded") if any_crowded else crowded
    calm = distinct.join(crowded, "anchor", "left_anti") if any_crowded else distinct
    n_buckets = max(16, -(-calm.count() // CELLS_PER_BUCKET))
    runs = _with_cells(texts, calm).mapInArrow(_runs(n_buckets), "bucket long, run binary")
    found = runs.groupBy("bucket").applyInPandas(_merge_bucket(windows), "c0 long, c1 long, left long, right long")
    if any_crowded:
        packed = distinct.join(crowded, "anchor", "left_semi")
        inner = materialize(_with_cells(texts, packed).mapInArrow(_cell_texts, "u0 long, u1 long, copies long, raw binary"), "crowded_cells")
        spans = repeated_spans(inner, windows, longer).withColumnsRenamed({"u0": "c0", "u1": "c1"})
        found = found.unionByName(spans.join(packed.select("c0", "c1", "before"), ["c0", "c1"]).select("c0", "c1", (F.col("before") - F.col("start")).alias("left"), (F.col("stop") - F.col("before")).alias("right")))
    return repeated.join(found, ["c0", "c1"]).select("u0", "u1", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))


def _union(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans; touching runs are one."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    return list(zip(a[new].tolist(), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])].tolist(), strict=True))


def _without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return raw
    pieces, at = [], 0
    for a, b in runs:
        pieces.append(raw[at:a])
        at = b
    return b"".join([*pieces, raw[at:]])


def deduplicate(docs: DataFrame, text_col: str = "text", result: str = "bytes", length: int = LENGTH, words: int | None = None, passages: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and what is left: ``kept``, as ``result`` says bytes or text (without
    the halves of characters that a cut has left), or for ``digest`` the SHA-256 of the bytes in hex as ``kept_sha256``. Existing
    columns of those names are replaced. Windows of ``length`` bytes count (64 to 1,023), or of ``words`` words where that is given.
    With ``passages``, a number of words, ``n_passages`` counts the maximal runs of repeated windows of so many words besides."""
    if words is None and not 64 <= length < 1024:
        raise ValueError(f"length {length} is out of range")
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", **({"kept_sha256": "string"} if result == "digest" else {"kept": "string" if result == "text" else "binary"}), **({"n_passages": "long"} if passages else {})}
    others = [f for f in docs.schema if f.name not in (*new, text_col)]
    raw = text_or_empty(text_col).cast("binary")
    # the columns come under numbers: their names may be those used here
    hashed = docs.select(F.xxhash64(F.lit(3), raw).alias("u0"), F.xxhash64(F.lit(5), raw).alias("u1"), *[F.col(f"`{f.name}`").alias(f"k{n}") for n, f in enumerate(others)], raw.alias("raw"))
    texts = hashed.select("u0", "u1", F.lit(1).cast("long").alias("copies"), "raw")
    spark, spans = docs.sparkSession, None
    for kind, w in ((0, Windows(words, True) if words else Windows(length)), (1, Windows(passages, True) if passages else None)):
        if w:
            path = f"{shared_folder(spark)}/spans{kind}"
            with scope(spark):  # cells and runs go once the spans stand
                found = repeated_spans(texts, w).select("u0", "u1", F.struct(F.lit(kind).alias("kind"), "start", "stop").alias("span")).distinct()
                found.write.parquet(path)
            found = spark.read.schema(found.schema).parquet(path)
            spans = found if spans is None else spans.unionByName(found)
    per_text = materialize(spans.groupBy("u0", "u1").agg(F.collect_set("span").alias("spans")), "spans")
    keys = per_text.select("u0").distinct()
    held = _holding(hashed, keys)
    names = [f"k{n}" for n in range(len(others))]
    if held is None:
        ready = hashed.join(per_text, ["u0", "u1"], "left").select(*names, "spans", "raw")
    else:  # texts without spans need no shuffle
        ready = held.join(per_text, ["u0", "u1"], "left").select(*names, "spans", "raw").unionByName(_holding(hashed, keys, "left_anti").select(*names, F.lit(None).cast(per_text.schema["spans"].dataType).alias("spans"), "raw"))
    finish = {"bytes": lambda left: left, "text": lambda left: left.decode("utf-8", "ignore"), "digest": lambda left: hashlib.sha256(left).hexdigest()}[result]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("cut", dict)
        for b in narrow(batches):
            rows, lists = [], b.column(b.num_columns - 2)
            edges = lists.offsets.to_numpy()
            which, start, stop = (c.to_numpy() for c in lists.values.flatten()) if len(lists.values) else [np.zeros(0, np.int64)] * 3
            for k, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
                x, y = edges[k], edges[k + 1]
                gone, seen = (_union(start[x:y][which[x:y] == kind], stop[x:y][which[x:y] == kind]) if y > x else [] for kind in (0, 1))
                rows.append((len(raw), sum(y - x for x, y in gone), len(gone), finish(_without(raw, gone)), len(seen)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if result == "bytes" else pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)][: len(new)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *columns], names=[*[f.name for f in others], *new])

    return ready.mapInArrow(cut, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{c} {kind}" for c, kind in new.items())]))
