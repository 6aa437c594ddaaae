"""What several corpus operators share: shared-folder staging, text access, and the cached byte-level BPE encoder."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.staging import materialize, shared_folder  # noqa: F401  the operators take them from here

BYTE_BPE = "byte_bpe_50k.json"
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_of_id(column: str | Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow filesystem and inner path of a folder URI (a plain path is local)."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pafs.LocalFileSystem(), uri


def release() -> None:
    """Gives the system back what this worker has freed, which the allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


_kept: dict = {}


def kept(name: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps for the next task of the same kind. A worker holds one such thing: a task of another kind drops it,
    so that the stages of a session don't add up in memory."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            release()
        _kept[name] = make()
    return _kept[name]


def empty_batch(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def narrow(batches: Iterator[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose last column (texts) holds at most ``most_bytes`` together; one longer text stands alone."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        a, total = 0, 0
        for k, n in enumerate(sizes.tolist()):
            if k > a and total + n > most_bytes:
                yield b.slice(a, k - a)
                a, total = k, 0
            total += n
        if b.num_rows:
            yield b.slice(a)


class _Units(dict):
    """Number of each distinct unit; units not seen before are noted in ``pending``."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.pending.append(unit)
        return n


class CachedEncoder:
    """The tokenizers library's ids for whole texts, each distinct space-delimited unit being encoded once.

    The byte-level pre-tokenizer never joins characters across the start of a run of blanks, so a text's ids are those of its units
    in order. That holds for the blanks below only: a text with any other white space goes to the library whole.
    """

    UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
    OTHER_SPACE = re.compile("[^\\S \\t\\n\\r]|[\\u180e\\u200b\\ufeff]")

    def __init__(self, path: str, most_units: int = 400_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most_units = most_units
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each id
        for piece, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(piece)
        self.tables: dict[str, np.ndarray] = {}  # what users derive from the vocabulary
        self._reset()

    def _reset(self) -> None:
        self.units, self.flat, self.used = _Units(), np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.odd: list[int] = []  # units with other white space: their texts go to the library whole

    def _encoded(self, texts: list[str], at_once: int) -> Iterator[np.ndarray]:
        """The ids of each text. The library's results hold each token's text and place too, so few are held at a time."""
        for a in range(0, len(texts), at_once):
            for e in self.tokenizer.encode_batch_fast(texts[a : a + at_once], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def _ids_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where each distinct unit's begin in it and how many they are. Units that start with a blank are
        encoded joined, in groups: a blank starts a token, so the bytes of the tokens tell where each unit ends. A group whose
        tokens don't end there is encoded unit by unit."""
        begin, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        joined = [k for k, u in enumerate(units) if u[0] in " \t\n\r" and u[-1] not in " \t\n\r"]
        groups = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        alone, pool, used = set(range(len(units))).difference(joined), [], 0
        texts = ["".join([units[k] for k in g]) for g in groups]
        for g, ids in zip(groups, self._encoded(texts, 16), strict=True):
            stops, want = np.cumsum(self.widths[ids]), np.cumsum([len(units[k].encode()) for k in g])
            at = np.searchsorted(stops, want)
            if len(stops) and at[-1] == len(stops) - 1 and (stops[at] == want).all():
                begin[g] = used + np.concatenate([[0], at[:-1] + 1])
                size[g] = np.diff(at, prepend=-1)
                pool.append(ids)
                used += len(ids)
            else:
                alone.update(g)
        rest = sorted(alone)
        for k, ids in zip(rest, self._encoded([units[k] for k in rest], 256), strict=True):
            begin[k], size[k] = used, len(ids)
            pool.append(ids)
            used += len(ids)
        return np.concatenate(pool), begin, size

    def _learn(self) -> None:
        units = self.units
        if not (new := units.pending):
            return
        first = len(units) - len(new)
        ids, begin, size = self._ids_of(new)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(units) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : len(units)] = self.used + begin
        self.size[first : len(units)] = size
        self.used += len(ids)
        if self.OTHER_SPACE.search("".join(new)):
            self.odd += [first + k for k, u in enumerate(new) if self.OTHER_SPACE.search(u)]

    def _forget(self, seen: int, used: int) -> None:
        """Once full, keep the units known so far (the frequent ones come early) and drop the newest; start anew if too few hit."""
        units = self.units
        if len(units) > self.most_units and units.pending:
            if len(units.pending) > 0.4 * seen:
                self._reset()
                return
            for u in units.pending:
                del units[u]
            self.used, self.odd = used, [k for k in self.odd if k < len(units)]
        units.pending = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other as uint32, ids of each text)."""
        find, at, used = self.UNIT.findall, self.units.__getitem__, self.used
        numbers = []
        for t in texts:
            units = find(t)
            numbers.append(np.fromiter(map(at, units), np.int64, len(units)))
        self._learn()
        per_text = np.fromiter(map(len, numbers), np.int64, len(numbers))
        rows = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        begin, sizes = self.begin[rows], self.size[rows]
        stop = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes, out=stop[1:])
        begin -= stop[:-1]
        ids = self.flat[np.arange(stop[-1]) + np.repeat(begin, sizes)]
        bounds = stop[np.concatenate([[0], np.cumsum(per_text)])]
        counts = np.diff(bounds)
        if self.odd and (hit := np.isin(rows, self.odd)).any():
            whole = np.unique(np.repeat(np.arange(len(texts)), per_text)[hit]).tolist()
            pieces = [ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            for k in whole:
                pieces[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                counts[k] = len(pieces[k])
            ids = np.concatenate(pieces)
        self._forget(len(rows), used)
        return ids, counts


def encoder_of(path: str) -> CachedEncoder:
    """The worker's encoder: what one task has learnt serves the next."""
    return kept(("encoder", path), lambda: CachedEncoder(path))


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text followed by ``end_id``."""
    stops = np.cumsum(counts)
    return np.insert(ids, stops, end_id), counts + 1
