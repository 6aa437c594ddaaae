"""Packing: order-preserving dynamic programming over window cuts.

The documents of a partition, each followed by the end id, form one stream in table order. A window is a run of the stream of at most
``limit`` tokens. Cuts fall at document ends (free), sentence ends (a small penalty) or, inside stretches without any, every
``STRIDE`` tokens (a larger one). The cuts minimise padding plus penalties: with f(j) the least cost of cutting at c_j,
f(j) = penalty(j) + min over c_i >= c_j - limit of f(i) + limit - (c_j - c_i), so a monotone queue of f(i) + c_i answers each j in
constant time. A window whose length is a power of two takes no padding.

Defined results: null text is empty (one end id); order within a partition is kept; a document longer than a window spans several;
repeated rows and ids are packed once each; an empty table gives no piece. Memory is bounded: the stream is solved ``CHUNK`` tokens at
a time, each chunk's last window being carried into the next.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import encoder_of, narrow, release, text_or_empty

STRIDE, CHUNK = 64, 1 << 20
ENCODED_BYTES = 1_000_000  # of texts encoded at once: a few arrays of eight bytes a token are held for them
SENTENCE_PENALTY, MIDDLE_PENALTY = 2.0, 16.0
SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", "\n")


def sentence_end_table(tokenizer) -> np.ndarray:
    """For each id, whether its text ends a sentence."""
    from tokenizers import decoders

    n, decode = tokenizer.get_vocab_size(), decoders.ByteLevel()
    ends = np.zeros(n, bool)
    for piece, i in tokenizer.get_vocab().items():
        ends[i] = decode.decode([piece]).rstrip("\"')]» ").endswith(SENTENCE_ENDS)
    return ends


def best_cuts(cuts: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Indices of the chosen cuts, first and last included. ``cuts`` ascends, with no gap over ``limit``."""
    m = len(cuts)
    pos, pen = array("q", cuts.astype(np.int64).tobytes()), array("d", penalty.astype(np.float64).tobytes())  # eight bytes a number, not an object
    exact, has_exact = [], np.zeros(m, bool)
    for size in (limit >> 1, limit >> 2, limit >> 3):  # shorter powers of two are not worth a window
        at = np.minimum(np.searchsorted(cuts, cuts - size), m - 1)
        at = np.where(cuts[at] == cuts - size, at, -1)
        has_exact |= at >= 0
        exact.append(array("q", at.astype(np.int64).tobytes()))
    half, quarter, eighth = exact
    has_exact = has_exact.tobytes()
    cost, back, reach = array("d", bytes(8 * m)), array("q", bytes(8 * m)), array("d", bytes(8 * m))
    queue, head = array("q", [0]), 0
    reach[0] = pos[0]
    for j in range(1, m):
        at = pos[j]
        least = at - limit
        while pos[queue[head]] < least:
            head += 1
        i = queue[head]
        best = reach[i] - least
        if has_exact[j]:
            for e in (half[j], quarter[j], eighth[j]):
                if e >= 0 and cost[e] < best:
                    best, i = cost[e], e
        best += pen[j]
        cost[j], back[j] = best, i
        g = reach[j] = best + at
        while len(queue) > head and reach[queue[-1]] >= g:
            queue.pop()
        queue.append(j)
    chosen, j = [m - 1], m - 1
    while j:
        j = back[j]
        chosen.append(j)
    return chosen[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to len(ids), with penalties."""
    n = len(ids)
    natural, at_doc = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    natural[1:] = ends[ids]
    at_doc[doc_ends] = at_doc[0] = at_doc[n] = True
    natural |= at_doc
    cuts = np.flatnonzero(natural)
    long = np.flatnonzero(np.diff(cuts) > STRIDE)
    between = natural.copy()
    for a, b in zip(cuts[long], cuts[long + 1], strict=True):
        between[a:b:STRIDE] = True
    cuts = np.flatnonzero(between)
    penalty = np.where(natural[cuts], SENTENCE_PENALTY, MIDDLE_PENALTY)
    penalty[at_doc[cuts]] = 0
    return cuts, penalty


def pack_stream(chunks: Iterator[tuple[list, np.ndarray, np.ndarray]], ends: np.ndarray, limit: int) -> Iterator[tuple]:
    """(doc keys, ids, counts) runs → arrays of pieces: key index list, start, length, total, window number, offset, and their ids."""
    keys: list = []  # of the documents with tokens in the buffer
    ids, left, begun, total = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = 0

    def solve(last: bool):
        nonlocal keys, ids, left, begun, total, windows
        doc_ends = np.cumsum(left)
        cuts, penalty = candidate_cuts(ids, doc_ends, ends)
        edges = cuts[best_cuts(cuts, penalty, limit)]
        keep = len(edges) - 1 if last or len(edges) <= 2 else len(edges) - 2
        stop = edges[keep]
        starts = np.union1d(np.concatenate([[0], doc_ends]), edges)
        starts = starts[starts <= stop]
        a, b = starts[:-1], starts[1:]
        doc, window = np.searchsorted(doc_ends, a, "right"), np.searchsorted(edges, a, "right") - 1
        doc_start = doc_ends - left
        out = ([keys[k] for k in doc], begun[doc] + a - doc_start[doc], b - a, total[doc], windows + window, a - edges[window], [ids[x:y] for x, y in zip(a, b, strict=True)])
        windows += keep
        first = int(np.searchsorted(doc_ends, stop, "right"))
        rest = np.maximum(0, stop - doc_start[first:])
        keys, begun, total, left, ids = keys[first:], begun[first:] + rest, total[first:], left[first:] - rest, ids[stop:]
        return out

    for new_keys, new_ids, counts in chunks:
        keys = keys + list(new_keys)
        ids, left, total = np.concatenate([ids, new_ids]), np.concatenate([left, counts]), np.concatenate([total, counts])
        begun = np.concatenate([begun, np.zeros(len(counts), np.int64)])
        if len(ids) >= CHUNK:
            yield solve(False)
    if len(ids):
        yield solve(True)


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless refused, the piece's ids.

    ``sequence_id`` is the partition's number times 2^40 plus the window's number in it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, encoder = TaskContext.get().partitionId() << 40, encoder_of(tokenizer)

        def chunks():
            for batch in narrow(batches, ENCODED_BYTES):
                flat, counts = encoder.encode(batch.column(1).to_pylist())
                yield batch.column(0).to_pylist(), np.insert(flat, np.cumsum(counts), end_id), counts + 1

        if "sentence ends" not in encoder.tables:
            encoder.tables["sentence ends"] = sentence_end_table(encoder.tokenizer)
        for key, start, length, total, window, offset, pieces in pack_stream(chunks(), encoder.tables["sentence ends"], limit):
            raw = [p.astype("<u4").tobytes() for p in pieces]
            columns = [pa.array(key, pa.int64()), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, raw)), pa.int64()), pa.array(total), pa.array(base + window), pa.array(offset), *([pa.array(raw, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            del key, start, length, total, window, offset, pieces, raw, columns
            release()

    slim = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
