"""Language identification with segmentation-marginalised unigram models.

Each language has a probability for every piece of one fixed public vocabulary. A word's likelihood is the sum, over all ways to cut
it into pieces, of the product of their probabilities (the forward algorithm); pieces never cross white space, so a text's log
likelihood is the sum over its words. Probabilities are fitted by expectation-maximisation (forward-backward) over word counts.

Words of one length are worked on together: the pieces at all places of all of them are looked up by hash, length by length, and the
recursion steps over the places with arrays of words x piece lengths x languages. Sums are rescaled at every place, so a word of any
length is scored whole, in stretches of ``STRETCH`` places that hand their sums on.

The fit reads about ``SAMPLE`` labelled documents of each language (all of them where there are no more): those whose text's hash lies
in the share of all hashes that holds so many. In the fit alone, a word beyond ``STRETCH`` characters counts as several. Word counts
are a Spark table; each round's expected counts are computed in tasks and summed by (language, piece), so the driver holds no more
than languages x vocabulary numbers.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no training row every text is; equal likelihoods
go to the language that sorts first; the score is the posterior probability under equal priors; repeated rows get a row each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import kept, materialize, narrow

SAMPLE, ROUNDS = 1000, 3
MOST_WORDS, MOST_CHARS = 150_000, 2_000_000  # remembered by a task
AT_ONCE = 1 << 20  # words x places x piece lengths x languages worked on together
STRETCH = 4096
UNSEEN, SMOOTH = 1e-7, 0.05
LEAST = 1e-120  # sums below are made relative to the place they belong to
MARK = "▁"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _codes(words: list[str]) -> np.ndarray:
    """A row of mixed code points for each word; the words have one length."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        x = (raw.astype(_U).reshape(len(words), -1) + _U(1)) * _U(0xD6E8FEB86659FD93)
        return (x ^ (x >> _U(32))) * _U(0xC4CEB9FE1A85EC53)


def _hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For d = 1 to ``longest``: a hash of the d characters from each place on."""
    h = np.zeros_like(codes)
    for d in range(min(longest, codes.shape[1])):
        with np.errstate(over="ignore"):
            h = h[:, : codes.shape[1] - d] + codes[:, d:] * _U(pow(_BASE, d + 1, 1 << 64))
        yield h


class Pieces:
    """A vocabulary, sorted by hash within each length. ``found`` numbers its pieces in the order given."""

    def __init__(self, pieces: list[str]) -> None:
        self.n, self.longest = len(pieces), max(map(len, pieces), default=1)
        by_length: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(k)
        self.tables = {}
        for d, ks in by_length.items():
            *_, h = _hashes(_codes([pieces[k] for k in ks]), d)
            order = np.argsort(h[:, 0])
            self.tables[d] = h[order, 0], np.array(ks, np.int64)[order]

    def found(self, words: list[str]) -> np.ndarray:
        """[word, place, d - 1] of words of one length: the piece of d characters that ends there; ``n`` for a single character that is
        none, ``n + 1`` for anything longer."""
        codes = _codes(words)
        m = codes.shape[1]
        out = np.full((len(words), m, min(self.longest, m)), self.n + 1, np.int64)
        out[:, :, 0] = self.n
        for d, h in enumerate(_hashes(codes, self.longest), 1):
            if d in self.tables:
                hashes, numbers = self.tables[d]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                out[:, d - 1 :, d - 1][hit] = numbers[at[hit]]
        return out


def _start(n: int, most: int, langs: int) -> np.ndarray:
    sums = np.zeros((n, most, langs))
    sums[:, -1] = 1.0
    return sums


def _forward(p: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p[word, place, d - 1, language] → log of the summed products up to each place, and the sums at the last places as shares of the
    last. ``before`` holds such shares of the places ahead of the first."""
    (n, m, most, langs), ahead = p.shape, before.shape[1]
    sums, scale = np.concatenate([before, np.empty((n, m, langs))], axis=1), np.zeros((n, langs))
    logs = np.empty((n, m, langs))
    for j in range(m):
        total = np.einsum("ndl,ndl->nl", sums[:, j + ahead - most : j + ahead][:, ::-1], p[:, j])
        sums[:, j + ahead], logs[:, j] = total, scale + np.log(total)
        if total.min(initial=1.0) < LEAST:  # from here on relative to this place
            sums[:, j + 1 : j + ahead + 1] /= total[:, None]
            scale = logs[:, j]
    return logs, sums[:, m:] / sums[:, -1:]


def _backward(p: np.ndarray) -> np.ndarray:
    """As ``_forward`` from the end: log of the summed products from each place on."""
    n, m, most, langs = p.shape
    turned = np.zeros_like(p)
    for d in range(most):
        turned[:, d:, d] = p[:, ::-1, d][:, : m - d]
    return _forward(turned, _start(n, most, langs))[0][:, ::-1]


def _together(words: list[str], width: int) -> Iterator[list[int]]:
    """Numbers of words of one length, as many as AT_ONCE allows."""
    lengths: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        lengths.setdefault(len(w), []).append(k)
    for m, ks in lengths.items():
        step = max(1, AT_ONCE // ((m + 1) * width))
        yield from (ks[a : a + step] for a in range(0, len(ks), step))


def word_likelihoods(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log likelihood of each word under each language. ``probs`` has a row for each piece, one of UNSEEN and one of zeros."""
    langs, most = probs.shape[1], pieces.longest
    out = np.zeros((len(words), langs))
    for ks in _together(words, most * langs):
        marked = [MARK + words[k] for k in ks]
        sums = _start(len(ks), most, langs)
        for a in range(0, len(marked[0]), STRETCH):
            start = max(0, a - most + 1)
            found = pieces.found([w[start : a + STRETCH] for w in marked])[:, a - start :]
            logs, sums = _forward(probs[found], sums)
            out[ks] += logs[:, -1]
    return out


def expected_counts(words: list[str], n: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected count of each piece in words that occur n times each, under one language's probabilities (forward-backward)."""
    out = np.zeros(pieces.n)
    for ks in _together(words, pieces.longest):
        found = pieces.found([MARK + words[k] for k in ks])
        p = probs[found][..., None]
        upto, on = _forward(p, _start(len(ks), p.shape[2], 1))[0][..., 0], _backward(p)[..., 0]
        before = np.pad(upto, ((0, 0), (1, 0)))[:, :-1]  # up to the place where a piece begins
        after = np.pad(on, ((0, 0), (0, 1)))[:, 1:]
        share = p[..., 0]
        for d in range(share.shape[2]):
            share[:, d:, d] *= np.exp(before[:, : before.shape[1] - d] + after[:, d:] - upto[:, -1:]) * n[ks][:, None]
            share[:, :d, d] = 0
        out += np.bincount(found.ravel(), share.ravel(), pieces.n + 2)[: pieces.n]
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probs: np.ndarray  # [piece, language], then a row of UNSEEN and one of zeros


def with_fallback(probs: np.ndarray) -> np.ndarray:
    return np.concatenate([probs, np.full((1, probs.shape[1]), UNSEEN), np.zeros((1, probs.shape[1]))])


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, lower-cased forms included as they are."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _sampled(docs: DataFrame, text_col: str, lang_col: str, sample: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of about ``sample`` different texts of each: a share of all hashes, so nothing is sorted."""
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).orderBy("lang").collect()  # texts, not rows
    shares = [(r["lang"], min(1.0, sample / max(1, r["n"]))) for r in sizes]
    if not shares:
        return [], labelled
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    place = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 40)) / float(1 << 40)
    return [s[0] for s in shares], labelled.join(share, "lang").where(place <= F.col("share")).dropDuplicates(["lang", "text"]).select("lang", "text")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in narrow(batches):
        c: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in text.lower().split():
                c.update((lang, w[k : k + STRETCH]) for k in range(0, len(w), STRETCH))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on labelled rows; rows with null text or language are left out."""
    spark = docs.sparkSession
    langs, chosen = _sampled(docs, text_col, lang_col, sample)
    if not langs:
        return LanguageModel([], [], with_fallback(np.zeros((0, 0))))
    words = materialize(chosen.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    vocab = vocabulary(model_path)
    probs = np.repeat(10.0 ** -(2 + np.array([[len(p)] for p in vocab]) / 3), len(langs), axis=1)
    spread = words.repartition(max(4, spark.sparkContext.defaultParallelism), "word")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, langs, with_fallback(probs)))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, langs, probs = shared.value
            pieces, sums = Pieces(vocab), np.zeros((len(vocab), len(langs)))
            for b in batches:
                lang, word, n = (np.array(b.column(k).to_pylist(), kind) for k, kind in ((0, object), (1, object), (2, float)))
                for k, name in enumerate(langs):
                    mine = np.flatnonzero(lang == name)
                    sums[:, k] += expected_counts(word[mine].tolist(), n[mine], pieces, probs[:, k])
            p, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(sums[p, k], pa.float64())], names=["lang", "piece", "x"])

        counts = np.zeros((len(vocab), len(langs)))
        for r in spread.mapInArrow(expect, "lang long, piece long, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).collect():  # at most languages x vocabulary
            counts[r["piece"], r["lang"]] = r["x"]
        seen = np.flatnonzero(counts.any(1))
        vocab, counts = [vocab[k] for k in seen], counts[seen]
        probs = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(seen))
        shared.unpersist()
    return LanguageModel(langs, vocab, with_fallback(probs))


class _Memory:
    """Likelihoods of the words met so far; once full, those met first (the frequent ones) stay."""

    def __init__(self, model: LanguageModel) -> None:
        self.pieces, self.probs = Pieces(model.pieces), model.probs
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, model.probs.shape[1]))
        self.chars = 0

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        row = self.row
        if len(row) > MOST_WORDS or self.chars > MOST_CHARS:
            for word in list(row)[len(row) // 2 :]:
                del row[word]
            self.chars = sum(map(len, row))
        first = len(row)
        out = [np.fromiter((row.setdefault(w, len(row)) for w in words), np.int64, len(words)) for words in texts]
        new = list(row)[first:]
        self.chars += sum(map(len, new))
        while len(row) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : len(row)] = word_likelihoods(new, self.pieces, self.probs)
        return out


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``lang_pred`` and ``score``; columns of those names are replaced."""
    others = [f for f in df.schema if f.name not in (text_col, "lang_pred", "score")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("language", dict)
        m = shared.value
        memory = _Memory(m) if m.languages else None
        for b in narrow(batches):
            texts = [t if memory and t is not None and any(map(str.isalpha, t)) else None for t in b.column(b.num_columns - 1).to_pylist()]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            asked = [k for k, t in enumerate(texts) if t is not None]
            rows = memory.rows([texts[k].lower().split() for k in asked]) if asked else []
            for k, r in zip(asked, rows, strict=True):
                total = memory.table[r].sum(0)
                best = int(total.argmax())
                langs[k], scores[k] = m.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*[f.name for f in others], "lang_pred", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return df.select(*[F.col(f"`{f.name}`") for f in others], F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}lang_pred string, score double")
