"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywright.llm import ann, components, decontam, language_id, packing, sharding, simhash, suffix_dedup, token_counts, token_index, toxicity
from tallywright.llm.common import BYTE_BPE, CachedEncoder

PATH = public_tokenizers.path(BYTE_BPE)
DOCS = "doc_id long, text string"
ODD = ["a \n\nfoo b", "  x  y\t\tz \n", "it's we'll 'd  's", "\x1cfoo\x1c? !\x1c?", "a  b \n\nfoo", "", "   ", "x\n \n y", "é​ü 12 3a4 <|endoftext|> z", "\u0085 a\u0085\nb", "日本語 テスト。\n次", "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def rows_with_edges():
    texts = [*ODD, None, "same text. Again.", "same text. Again."]
    return [*enumerate(texts), (None, "no id"), (3, "second of id 3"), (3, "second of id 3")]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns named like outputs
        for c in ("start", "score", "shard", "slot", "n_tokens", "fp", "component_id", "position", "text_hash", "n_bytes"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return frame(spark, []).where("false")


@pytest.mark.parametrize("most", [3, 400_000])
def test_encoder_equals_library(reference, most):
    e = CachedEncoder(PATH, most)
    for _ in range(2):
        ids, counts = e.encode(ODD)
        at = np.concatenate([[0], np.cumsum(counts)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [reference.encode(t, add_special_tokens=False).ids for t in ODD]


def test_token_index_round_trip(spark, reference):
    rows = rows_with_edges()
    store = token_index.write_token_store(frame(spark, rows), PATH)
    got = token_index.documents_of(store).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])])[:-1])
    keys = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    reader, of = token_index.IndexReader(store), {}
    for i, t in rows:
        of.setdefault(i, []).append([*reference.encode(t or "", add_special_tokens=False).ids, 0])
    for i, several in of.items():
        assert sorted(reader.get(i, k).tolist() for k in range(len(several))) == sorted(several) and reader.get(i, len(several)) is None
    assert not any(reader.get(10_000 + k) is not None for k in range(50))
    unknown = spark.createDataFrame([(10_000 + k, 0) for k in range(50)], "key_id long, occurrence long")
    assert token_index.lookup(store, unknown).count() == 0
    assert token_index.documents_of(token_index.write_token_store(empty(spark), PATH)).count() == 0


def test_token_index_splits_a_hot_id_over_shards(spark, reference):
    rows = [(7, f"text {k} of the same id") for k in range(300)] + [(None, f"no id {k}") for k in range(200)] + [(k, "x") for k in (1, 9)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_index.write_token_store(df, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.catalog.where("key_id = 7").select("shard").distinct().count() > 1
    got = token_index.documents_of(store).collect()
    want = Counter((i, zlib.crc32(np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    keys = [tuple(r) for r in store.catalog.select("key_id", "occurrence").collect()]
    assert len(set(keys)) == len(rows) and sorted(o for k, o in keys if k == 7) == list(range(300))
    reader = token_index.IndexReader(store)
    assert all(reader.get(7, k) is not None for k in (0, 150, 299)) and reader.get(7, 300) is None and reader.get(None, 199) is not None


def test_minimal_perfect_hash():
    keys = token_index.mixed(np.arange(5000, dtype=np.uint64), 9)
    h = token_index.MinimalPerfectHash.build(keys)
    again = token_index.MinimalPerfectHash.from_bytes(h.to_bytes())
    assert sorted(again.slots(keys)) == list(range(5000)) and len(token_index.MinimalPerfectHash.build(keys[:0])) == 0


def test_packing(spark, reference):
    rows = [*rows_with_edges(), (99, "no sentence ends here " * 4000)]
    got = packing.pack(frame(spark, rows), PATH).collect()
    total = sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total
    by_sequence = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0) and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 1024
    seen = Counter(i for i, _ in rows)
    for i, t in rows:
        if seen[i] == 1:  # the pieces of a document are its ids, in order and without gaps
            pieces, want = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start), [*reference.encode(t or "", add_special_tokens=False).ids, 0]
            assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == want
            assert [p.start for p in pieces] == list(np.concatenate([[0], np.cumsum([p.length for p in pieces])])[:-1]) and {p.doc_tokens for p in pieces} == {len(want)}
    padded = [(n, 1024 - n) for n in by_sequence.values() if n & (n - 1)]
    assert sum(p for _, p in padded) < 0.25 * total  # a handful of sequences, one cut short by the end of each partition
    assert packing.pack(empty(spark), PATH).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        gaps = [rng.randint(1, 16) for _ in range(rng.randint(1, 40))]
        cuts = np.concatenate([[0], np.cumsum(gaps)])
        penalty = np.array([0.0, *[rng.choice([0, 2, 16]) for _ in gaps[:-1]], 0.0]) if len(gaps) > 1 else np.zeros(2)
        cost = lambda a, b: 0 if b - a in (16, 8, 4) else 32 - (b - a) if b - a <= 32 else float("inf")
        best = [0.0] + [float("inf")] * len(gaps)
        for j in range(1, len(cuts)):
            best[j] = penalty[j] + min(best[i] + cost(cuts[i], cuts[j]) for i in range(j))
        chosen = packing.best_cuts(cuts, penalty, 32)
        assert sum(cost(cuts[i], cuts[j]) + penalty[j] for i, j in zip(chosen[:-1], chosen[1:], strict=True)) == pytest.approx(best[-1])


def test_token_counts(spark, reference):
    rows = rows_with_edges()
    hist = token_counts.length_histogram(frame(spark, rows), PATH)
    n = np.array([len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows])
    for r in token_counts.context_limits(hist).collect():
        assert (r.docs_cut, r.tokens_kept, r.tokens_lost) == ((n > r.length).sum(), np.minimum(n, r.length).sum(), np.maximum(0, n - r.length).sum())
    for r in token_counts.answer(hist, [1, 7, 1024, 100_000]).collect():
        assert r.tokens_kept == np.minimum(n, r.context_limit).sum() and r.docs_fit == (n <= r.context_limit).sum()
    assert token_counts.answer(hist, [1, 7, 1024, 7]).count() == 3
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.share: r.length for r in token_counts.quantiles(hist, shares).collect()}
    assert got == {q: int(min(x for x in n if (n <= x).sum() >= q * len(n))) for q in shares}
    assert token_counts.quantiles(hist.where("false"), shares).count() == 0
    assert token_counts.context_limits(token_counts.length_histogram(empty(spark), PATH)).count() == 0


@pytest.mark.parametrize("n", [0, 5, 1003])
def test_sharding(spark, n):
    df = frame(spark, [(i % 400 if i % 7 else None, f"t{i % 3}") for i in range(n)]).repartition(5)
    got = sharding.shuffle_into_shards(df, 16, ["doc_id", "text"]).collect()
    assert len(got) == n and Counter((r.doc_id, r.text) for r in got) == Counter((i % 400 if i % 7 else None, f"t{i % 3}") for i in range(n))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(16)), default=0) <= 1
    for k, size in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(size))


def test_hypergeometric_matches_its_law():
    from math import comb

    rng = random.Random(1)
    found = Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(20_000))
    assert all(abs(found[k] / 20_000 - comb(7, k) * comb(5, 6 - k) / comb(12, 6)) < 0.015 for k in range(1, 7))
    matrix = np.array(sharding.communication_matrix([10, 0, 25], [12, 12, 11], 4))
    assert matrix.sum(0).tolist() == [12, 12, 11] and matrix.sum(1).tolist() == [10, 0, 25]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("hot", [2, 1024])
def test_simhash_components(spark, hot, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = rows_with_edges()
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + k, " ".join(t)))
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, hot))
    got = simhash.near_duplicate_components(frame(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((i, f) for (i, _), f in zip(rows, prints, strict=True))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(find(k))) for k, (i, _) in enumerate(rows))
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert len(kept) == len({find(k) for k in range(len(rows))})


def test_covering_masks_cover():
    masks = simhash.covering_masks(list(range(64)))
    rng = random.Random(2)
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(flip & m == 0 for m in masks)


def test_twice_masked_simhash_buckets_are_bounded():
    for mask in simhash.covering_masks(list(range(64))):
        free = [b for b in range(64) if not mask >> b & 1]
        assert all(sum(not again >> b & 1 for b in free) <= 16 for again in simhash.covering_masks(free))


def test_components_on_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}
    assert components.connected_components(links.where("false")).count() == 0


def brute_repeats(texts):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[p : p + 400] for r in raws for p in range(len(r) - 399))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - 399):
            if count[r[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 3, 2048])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, line = some(800), some(390)
    texts = [None, "", "x" * 900, "ab" * 450, some(300)]
    for _ in range(30):
        t = some(rng.randint(0, 500)) + rng.choice([common, common[: rng.randint(380, 800)], common[rng.randint(0, 350) :], line, ""]) + some(rng.randint(0, 400))
        texts += [t[: len(t) // 2] + "é" + t[len(t) // 2 + 1 :] if rng.random() < 0.3 else t] * (1 + (rng.random() < 0.2))
    got = suffix_dedup.deduplicate(frame(spark, list(enumerate(texts))), result="digest").orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute_repeats(texts)
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    entries = [(rng.choice([b"A" * 8, b"B" * 8]) + bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))), b"x", (k, -k), k % 3 == 0) for k in range(300)]
    out = list(suffix_dedup.merge_runs([suffix_dedup.front_code(sorted(entries[i::5])) for i in range(5)]))
    assert sorted(e for _, e in out) == sorted(entries) and [e[0] for _, e in out] == sorted(e[0] for e in entries)
    assert all(h == suffix_dedup.common_prefix(p[0], e[0]) for (h, e), (_, p) in zip(out[1:], out, strict=False))


def test_toxicity(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice(["an", "er", "ti", "on", "th", "he", "in", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    bad = ["wretched", "vermin", "dimwit", "loathsome", "cretin"]

    def text(toxic):
        t = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(2, 5) if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        return " ".join(t)

    rows = [(i, text(i % 4 == 0)) for i in range(1200)]
    docs = frame(spark, [*rows, (None, "x"), (5000, None), (5001, ""), (5002, "y" * 100_000)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows[:800]] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).select("doc_id", "score").collect()}
    assert len(got) == 1204 and all(0 <= s <= 1 for s in got.values())
    new = rows[800:]
    assert np.mean([got[i] >= 0.7 for i, _ in new if i % 4 == 0]) > 0.85
    assert np.mean([got[i] >= 0.7 for i, _ in new if i % 4]) < 0.05
    none = toxicity.fit_on(docs, labels.where("false"), F.lit(True))
    assert toxicity.score_texts(docs, none).where("score >= 0.7").count() == 0
    assert toxicity.score_texts(empty(spark), none).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "es": ["ción", "que", "los", "mente", "ñ"], "de": ["sch", "ung", "keit", "ein", "ß"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    rows = [(i, text(lang), lang) for i in range(120) for lang in [list(parts)[i % 3]]]
    docs = spark.createDataFrame([*rows[:90], (900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    asked = frame(spark, [*[(i, t) for i, t, _ in rows[90:]], (1, None), (2, ""), (3, "12 34 !"), (4, "que" * 5000)])
    got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[90:])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[4].lang_pred == "es"
    nothing = language_id.fit(docs.where("false"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.predict(asked, nothing).collect()} == {"und"}


def segmentations(word):
    return [[word[:k], *rest] for k in range(1, len(word) + 1) for rest in segmentations(word[k:])] if word else [[]]


def brute_likelihood(word, p):
    """Every segmentation written out; single characters that are no piece have the least probability."""
    total = 0.0
    for cut in segmentations(language_id.MARK + word):
        total += np.prod([p.get(x, language_id.UNSEEN if len(x) == 1 else 0.0) for x in cut])
    return total


def slow_likelihood(word, p, longest=16):
    """Log likelihood by an exact dynamic program over fractions of any size."""
    from fractions import Fraction
    from math import log

    x = language_id.MARK + word
    alpha = [Fraction(1)]
    for j in range(1, len(x) + 1):
        alpha.append(sum((alpha[i] * Fraction(q) for i in range(max(0, j - longest), j) if (q := p.get(x[i:j], language_id.UNSEEN if j == i + 1 else 0.0))), Fraction(0)))
    return log(alpha[-1].numerator) - log(alpha[-1].denominator)


PIECES = {"▁": 0.1, "a": 0.2, "b": 0.3, "▁a": 0.05, "ab": 0.07, "▁ab": 0.01, "bab": 0.02, "é": 0.004}


def test_forward_sums_all_segmentations(monkeypatch):
    pieces, probs = language_id.Pieces(list(PIECES)), language_id.with_fallback(np.array([[q, q / 2] for q in PIECES.values()]))
    words = ["ab", "a", "b", "babab", "aébz", "日本ab", "abababab", "ab", "zzzz", "\U0001f600a"]
    got = language_id.word_likelihoods(words, pieces, probs)
    assert np.allclose(np.exp(got[:, 0]), [brute_likelihood(w, PIECES) for w in words], rtol=1e-12)
    assert np.allclose(np.exp(got[:, 1]), [brute_likelihood(w, {k: q / 2 for k, q in PIECES.items()}) for w in words], rtol=1e-12)
    for stretch in (7, 4096):  # long words: whole, and handed on from stretch to stretch
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        for w in ("z" * 300, "bab" * 100, "ab日" * 70):
            assert language_id.word_likelihoods([w], pieces, probs)[0, 0] == pytest.approx(slow_likelihood(w, PIECES), rel=1e-12)
    assert language_id.word_likelihoods([], pieces, probs).shape == (0, 2)


def test_expected_counts_are_those_of_all_segmentations():
    pieces = language_id.Pieces(list(PIECES))
    words, n = ["ab", "babab", "aébz", "ab"], np.array([2.0, 1.0, 3.0, 1.0])
    got = language_id.expected_counts(words, n, pieces, language_id.with_fallback(np.array(list(PIECES.values()))[:, None])[:, 0])
    want = Counter()
    for w, times in zip(words, n, strict=True):
        for cut in segmentations(language_id.MARK + w):
            share = np.prod([PIECES.get(x, language_id.UNSEEN if len(x) == 1 else 0.0) for x in cut]) / brute_likelihood(w, PIECES)
            for x in cut:
                want[x] += times * share
    assert np.allclose(got, [want[x] for x in PIECES], rtol=1e-9)


@pytest.mark.parametrize("remembered", [4, 150_000])
def test_language_id_equals_brute_force(spark, remembered, monkeypatch):
    """Each text's language and score from sums over the written-out segmentations of its words; ties go to the first language."""
    monkeypatch.setattr(language_id, "MOST_WORDS", remembered)
    model = language_id.LanguageModel(["x", "y", "z"], list(PIECES), language_id.with_fallback(np.array([[q, q * (0.5 if len(k) > 1 else 1.2), q] for k, q in PIECES.items()])))
    by_lang = [{k: model.probs[i, n] for i, k in enumerate(PIECES)} for n in range(3)]
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abébz") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts += [texts[0], texts[0], "A B", " \n\t", "12", None, "", "ab " * 2000]
    got = {r.doc_id: r for r in language_id.predict(frame(spark, list(enumerate(texts))), model).collect()}
    for k, t in enumerate(texts):
        if t is None or not any(map(str.isalpha, t)):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        total = [sum(np.log(brute_likelihood(w, p)) for w in t.lower().split()) for p in by_lang]
        assert got[k].lang_pred == ("x" if total[0] >= total[1] - 1e-9 else "y")
        assert got[k].score == pytest.approx(1 / sum(np.exp(v - max(total)) for v in total), rel=1e-6)


def test_decontamination(spark):
    items = [(1, "A train leaves Paris at 30 km per hour and Paris is 90 km away. How long does the train need to reach the town?"), (2, "What is the capital of the country that borders the long river in the north?"), (3, None), (4, "short one"), (5, "A train leaves Paris at 30 km per hour and Paris is 90 km away. How long does the train need to reach the town?")]
    filler = "there was nothing of note in this part of the text, and nobody minded. "
    changed = items[0][1].replace("30", "45").replace("90", "270").replace("Paris", "Lyon")
    broken = changed.replace("and Lyon is", "and Madrid is")
    docs = [(10, filler + items[0][1] + filler), (11, filler + changed), (12, filler + broken), (13, filler * 5), (14, None), (15, ""), (16, items[1][1].upper()), (17, filler + "a short one indeed"), (None, items[1][1]), (10, filler + items[0][1] + filler)]
    got = decontam.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id, r.kind) for r in got}
    assert (10, 1, "exact") in found and (11, 1, "reparameterised") in found and (None, 2, "exact") in found
    assert not {12, 13, 14, 15} & {d for d, _, _ in found}
    kept = decontam.remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {12, 13, 14, 15} <= {r.doc_id for r in kept} and not {10, 11} & {r.doc_id for r in kept}
    assert decontam.contaminated(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.contaminated(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("group", [64, 8192])
def test_nearest_neighbours(spark, group):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype("f4")
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 3), (504, [1.0] * 15 + [None]), (7, x[7].tolist()), (None, x[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.search(df, F.col("vec_id") % 20 == 0, window=16, group_rows=group).collect()
    y, ids = np.concatenate([x, x[7:8]]).astype(float), np.array([*range(400), 7])  # a repeated row is a row
    for q in range(0, 400, 20):
        s = ann.scores(y[q], y)
        want = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == ids[want].tolist() and [r["rank"] for r in mine] == list(range(1, 21))
        assert np.allclose([r.score for r in mine], s[want], atol=1e-12)
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4 and ann.search(df.where("false"), F.lit(True)).count() == 0


def test_hilbert_curve_visits_neighbours():
    c = np.array([[a, b, d] for a in range(4) for b in range(4) for d in range(4)])
    walk = c[np.argsort(ann.hilbert_keys(c, 2))]
    assert np.abs(np.diff(walk, axis=0)).sum(1).max() == 1
