"""Toxicity by compression distance with two trained zstandard dictionaries.

Text is read as windows: lower-cased words with a blank on either side. One dictionary is trained on windows of toxic training
documents (those that occur there at several times the ordinary rate), the other on windows of ordinary ones. A window's evidence is
its pair of compressed lengths, one under each dictionary, looked up in thresholds calibrated on documents the dictionaries have not
seen: the log odds of toxic against ordinary for that window length and pair. A document's evidence is summed up in a few numbers
(strongest windows, share of strong windows), which a logistic fit turns into a score.

zstandard works in whole bytes, too coarse for single words. Each byte of a window and of the dictionaries' content is therefore
written as three fixed bytes; a match then saves three bytes per character, and lengths count phrases.

The fit reads a bounded sample: at most ``SAMPLE`` labelled documents of each class, those with the smallest hash of their id, copies
taken once, and of these so many that their texts fill at most ``SAMPLE_BYTES``. Scoring reads every text whole. Defined results: null, empty and wordless texts score as documents without evidence;
repeated rows get one score each; with no label of one class every score is that class's share; labels beyond 0 and 1 are left out.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import kept, narrow, text_or_empty

SAMPLE = 3000
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 4096, 110_000, 7
RATE, SHARE = 8.0, 0.008  # a toxic window occurs RATE times as often as in ordinary text, and in SHARE of toxic documents
SAMPLE_BYTES = 24_000_000  # of each class's texts that go to the driver
MOST_WINDOWS, LONG_WINDOW = 120_000, 48  # remembered by a worker: so many, none longer
_WIDE = [bytes([b, (b * 29 + 17) & 255, (b * 58 + 101) & 255]) for b in range(256)]


def widened(window: bytes) -> bytes:
    return b"".join([_WIDE[b] for b in window])


def windows_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


@dataclass
class ToxicityModel:
    toxic: bytes = b""
    ordinary: bytes = b""
    odds: dict[tuple[int, int, int], float] = field(default_factory=dict)
    unseen: float = 0.0
    weights: tuple[float, ...] = (0.0,) * 5
    bias: float = 0.0

    def lengths(self):
        """A function from a window to (its length, length under the toxic dictionary, under the ordinary one)."""

        def under(content: bytes):
            d = zstandard.ZstdCompressionDict(widened(content) or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        a, b = under(self.toxic), under(self.ordinary)

        def measure(window: bytes) -> tuple[int, int, int]:
            wide = widened(b" " + window + b" ")
            return min(len(window), 20), len(a(wide)), len(b(wide))

        return measure

    def evidence(self):
        """A function from a window to its log odds, remembered by window."""
        measure, odds, unseen = self.lengths(), self.odds, self.unseen

        class Known(dict):
            def __missing__(self, window: bytes) -> float:
                v = odds.get(measure(window), unseen)
                if len(window) <= LONG_WINDOW:
                    self[window] = v
                return v

        return Known()


def summary(values: list[float]) -> np.ndarray:
    """What a document's windows say: strongest, five strongest, share of strong ones and their number, and a little of the length."""
    v = np.asarray(values, float)
    if not len(v):
        return np.zeros(5)
    top = np.sort(v)[::-1][:5] if len(v) <= 5 else np.sort(np.partition(v, len(v) - 5)[-5:])[::-1]
    top = np.concatenate([top, np.full(5 - len(top), min(0.0, top[-1]))])
    strong = int((v > 1.5).sum())
    return np.array([top[0], top.sum() / 5, np.log1p(1000 * strong / max(len(v), 200)), np.log1p(strong), np.log1p(len(v)) / 10])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _without_copies(texts: list[str]) -> list[list[bytes]]:
    """Windows of each text, copies and near copies of an earlier text left out (they share a smallest five-word shingle)."""
    seen, out = set(), []
    for t in texts:
        w = windows_of(t)
        marks = [zlib.crc32(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))]
        least = {(0, min(marks)), (1, min((m * 2654435761) & 0xFFFFFFFF for m in marks))}
        if not least & seen:
            out.append(w)
        seen |= least
    return out


def _train(samples: list[bytes], size: int) -> bytes:
    """The content zstandard's trainer picks from the samples; the samples themselves where they are too few to train on."""
    samples = list(samples)
    random.Random(size).shuffle(samples)  # the trainer picks from one stretch of its input after the other
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    bad, good = Counter(w for d in toxic for w in set(d)), Counter(w for d in ordinary for w in set(d))
    least = max(3, SHARE * len(toxic))
    odd = sorted((w, c) for w, c in bad.items() if c >= least and c > RATE * (good[w] + 0.5) * len(toxic) / max(1, len(ordinary)))
    mine = [b" " + w + b" " for w, c in odd for _ in range(c)]
    usual = [b" " + w + b" " for w, c in sorted(good.items()) if c >= 2 for _ in range(min(c, 50))]
    return _train(mine, TOXIC_BYTES), _train(usual[:: max(1, len(usual) // 200_000)], ORDINARY_BYTES)


def _odds(model: ToxicityModel, toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> None:
    measure, cells = model.lengths(), {}
    known: dict[bytes, tuple[int, int, int]] = {}
    for label, docs in ((0, toxic), (1, ordinary)):
        for d in docs:
            for w in set(d):
                c = known.get(w) or known.setdefault(w, measure(w))
                cells.setdefault(c, [0, 0])[label] += 1
    n = [sum(c[k] for c in cells.values()) or 1 for k in (0, 1)]
    model.odds = {c: float(np.log((a + 1.0) / (n[0] + 2) / ((b + 1.0 * n[1] / n[0]) / (n[1] + 2)))) for c, (a, b) in cells.items()}


def fit(toxic_texts: list[str], ordinary_texts: list[str]) -> ToxicityModel:
    """Cross-fitted: the odds and the logistic fit come from documents that the dictionaries of their fold have not seen."""
    toxic, ordinary = _without_copies(toxic_texts), _without_copies(ordinary_texts)
    model = ToxicityModel()
    if len(toxic) < 2 or len(ordinary) < 2:
        p = (len(toxic) + 0.01) / (len(toxic) + len(ordinary) + 0.02)
        model.bias = float(np.log(p / (1 - p))) if toxic or ordinary else -4.0
        return model
    x, y = [], []
    for f in (0, 1):
        part = ToxicityModel(*_dictionaries(toxic[1 - f :: 2], ordinary[1 - f :: 2]))
        here, there = (toxic[f::4], ordinary[f::4]), (toxic[f + 2 :: 4], ordinary[f + 2 :: 4])
        for a, b in ((here, there), (there, here)):
            _odds(part, *a)
            known = part.evidence()
            for label, docs in ((1, b[0]), (0, b[1])):
                x += [summary([known[w] for w in d]) for d in docs]
                y += [label] * len(docs)
    model.toxic, model.ordinary = _dictionaries(toxic, ordinary)
    # the final odds: again by folds, so that no window is measured under a dictionary trained on its own document
    sums: dict[tuple[int, int, int], list[float]] = {}
    for f in (0, 1):
        part = ToxicityModel(*_dictionaries(toxic[1 - f :: 2], ordinary[1 - f :: 2]))
        _odds(part, toxic[f::2], ordinary[f::2])
        for c, v in part.odds.items():
            sums.setdefault(c, []).append(v)
    model.odds = {c: sum(v) / 2 if len(v) == 2 else v[0] / 2 for c, v in sums.items()}
    w, model.bias = logistic(np.array(x), np.array(y, float))
    model.weights = tuple(float(v) for v in w)
    return model


def score_texts(df: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text; a column of that name is replaced."""
    others = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    weights, bias = np.array(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("toxicity", dict)
        known = model.evidence()
        for batch in narrow(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = []
            for t in texts:
                if len(known) > MOST_WINDOWS:
                    known.clear()
                z = float(summary([known[w] for w in windows_of(t)]) @ weights) + bias
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - 1], pa.array(scores, pa.float64())], names=[*others, out])

    return df.select(*[F.col(f"`{c}`") for c in others], text_or_empty(text_col).alias("__text")).mapInArrow(run, f"{schema}, `{out}` double")


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled ids of each class, and ``SAMPLE_BYTES`` of their texts, among those where ``usable`` (an
    expression over ``id_col``) holds. An id with labels of both kinds counts as toxic; equal rows of an id count once."""
    marked = labels.where(usable & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    order = F.xxhash64(F.lit(7), id_col)
    chosen = [marked.where(F.col("__label") == k).orderBy(order, id_col).limit(sample) for k in (1, 0)]
    picked = chosen[0].unionByName(chosen[1])  # at most 2 x sample ids and labels
    text = text_or_empty(text_col)
    slim = docs.select(id_col, F.xxhash64(text).alias("__hash"), F.octet_length(text).alias("__size")).join(F.broadcast(picked), id_col)
    slim = slim.where(F.col("__size") <= SAMPLE_BYTES).groupBy(id_col, "__hash").agg(F.max("__label").alias("__label"), F.max("__size").alias("__size"))
    slim = slim.withColumn("__order", order).orderBy("__order", "__hash").limit(4 * sample)
    upto = Window.partitionBy("__label").orderBy("__order", "__hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = slim.withColumn("__bytes", F.sum("__size").over(upto)).where(F.col("__bytes") <= SAMPLE_BYTES)
    # texts are fetched last, for the rows that stay: at most 4 x sample of them
    wanted = slim.select(F.col(id_col).alias("__id"), F.col("__hash").alias("__h"), "__label", "__order")
    found = docs.select(id_col, text.alias("__text")).join(F.broadcast(wanted), (F.col(id_col) == F.col("__id")) & (F.xxhash64("__text") == F.col("__h")))
    found = found.dropDuplicates([id_col, "__h"]).select("__label", "__order", "__h", "__text").collect()
    rows = sorted(found, key=lambda r: (r["__order"], r["__h"]))
    return fit([r["__text"] for r in rows if r["__label"] == 1], [r["__text"] for r in rows if r["__label"] == 0])
