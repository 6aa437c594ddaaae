"""Cases that an earlier version left out."""

from __future__ import annotations

import random
import re
from collections import Counter


import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import ann, decontam, suffix_dedup, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def five_word_sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_keeps_one_of_texts_that_share_most_shingles(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two words")]
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for k in range(5):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((10 + 10 * g + k, " ".join(t)))
    sets = {i: five_word_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = corpus_pipeline.keep_one_of_near_copies(spark, documents(spark, rows), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == sorted({find(i) for i in sets})


def brute_word_cut(texts, n):
    found = [[(m.start(), m.end()) for m in re.finditer(rb"\S+", t)] for t in texts]
    count = Counter(t[w[k][0] : w[k + n - 1][1]] for t, w in zip(texts, found, strict=True) for k in range(len(w) - n + 1))
    out = []
    for t, w in zip(texts, found, strict=True):
        gone = [False] * len(t)
        for k in range(len(w) - n + 1):
            a, b = w[k][0], w[k + n - 1][1]
            if count[t[a:b]] > 1:
                gone[a:b] = [True] * (b - a)
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g).decode())
    return out


def test_pipeline_cuts_short_worded_passages_of_over_fifty_words(spark):
    rng = random.Random(4)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, size))) for _ in range(n))
    short, longer, fifty = words(60, 3), words(80, 9), words(50, 9)
    left, right = words(30, 9), words(30, 9)
    assert 101 <= len(short.encode()) < 256
    texts = [f"{words(20, 7)} {short} {words(20, 7)}", f"{words(9, 7)} {short} {words(30, 7)}", f"x{longer} {words(5, 7)}", f"{words(5, 7)} {longer}y"]
    texts += [f"{words(20, 7)} {fifty} {words(20, 7)}", f"{words(20, 7)} {fifty} {words(20, 7)}"]  # repeated, not long enough
    texts += [f"{words(9, 7)} {left} {words(9, 7)}", f"{words(9, 7)} {right} {words(9, 7)}", f"{left} {right}"]  # two short repeats side by side
    texts += [" ".join("a" * 51), " ".join("a" * 51), "copy " + words(70, 5), ""]
    texts.append(texts[-2])
    got = corpus_pipeline.cut_repeats(spark, documents(spark, list(enumerate(texts))), "").orderBy("doc_id").collect()
    assert [r.text for r in got] == brute_word_cut([t.encode() for t in texts], 51)


@pytest.mark.parametrize("n", [5, 10])
def test_op9_decontamination_finds_every_document_at_exactly_the_cover(spark, n):
    """One end word differs for each missing window: of n windows, a fifth may be missing, wherever the seeds are."""
    words = [f"w{n}x{k}" for k in range(n + 4)]
    missing = n // 5
    docs = []
    for left in range(missing + 1):
        t = list(words)
        for k in range(left):
            t[k] = f"other{k}"
        for k in range(missing - left):
            t[-1 - k] = f"else{k}"
        docs.append((left, " ".join(t)))
    items = [(k, " ".join([*words[: n + 4 - 5 * k], *[f"v{k}y{j}" for j in range(5 * k)]])) for k in range(2)]
    items += [(10 + k, " ".join(words[k : k + 5])) for k in range(1, n - 1)]  # makes the inner windows frequent, the end ones rare
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {r.doc_id for r in got.where(f"n_windows = {n} and item_id = 0").collect()}
    assert hit == set(range(missing + 1))


def test_op9_decontamination_reads_words_that_open_sentences_as_names_too(spark):
    item = "Tom has 12 apples in a basket. Tom gives 5 of them to Anna. Tom then buys 3 more apples at the market. How many apples does he have now?"
    inside = "Yesterday Tom has 12 apples in a basket. Tom gives 5 of them to Anna. Tom then buys 3 more apples at the market. How many apples does he have now?"
    docs = [(0, item), (1, item.replace("Tom", "Jerry")), (2, "It was so. " + item.replace("Tom", "Jerry").replace("12", "40")), (3, inside.replace("Tom", "Mia")), (4, item.replace("Tom", "Jerry", 1).replace("Tom", "Mia", 1).replace("Tom", "Leo", 1)), (5, item.replace("apples", "pears").replace("gives", "hands"))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(0, "exact"), (1, "reparameterised"), (2, "reparameterised"), (3, "reparameterised")}


def test_op9_decontamination_finds_short_items_inside_longer_texts(spark):
    items = [(1, "Seven blue herons sing"), (2, "Zanzibar"), (3, "")]
    docs = [(0, "In the marsh, seven blue herons sing at dawn, and seven blue herons sing at dusk."), (1, "seven blue herons sleep at dawn"), (2, "we went to Zanzibar by boat last year"), (3, "zanzibar"), (4, "seven blue herons")]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(0, 1, "exact"), (2, 2, "exact"), (3, 2, "exact")}


def brute_byte_cut(texts):
    raws = [t.encode() for t in texts]
    count = Counter(r[p : p + 400] for r in raws for p in range(len(r) - 399))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for p in range(len(r) - 399):
            if count[r[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        out.append(bytes(np.frombuffer(r, np.uint8)[np.cumsum(gone)[:-1] == 0]))
    return out


@pytest.mark.parametrize("hot", [1, 2048])
def test_op5_suffix_dedup_codes_each_text_once(spark, hot, monkeypatch):
    """A text of many copies that shares a passage with a differing one enters the runs once."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = some(600)
    copied, other = some(300) + common + some(200), some(250) + common + some(100)
    texts = [copied] * 40 + [other]
    seen, made = spark.sparkContext.accumulator(0), suffix_dedup._runs
    monkeypatch.setattr(suffix_dedup, "HOT", hot)

    def counted(*args):
        run = made(*args)

        def rows(batches):
            def tally():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return run(tally())

        return rows

    monkeypatch.setattr(suffix_dedup, "_runs", counted)
    got = suffix_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [len(copied)] * 40 + [600]
    assert hot == 1 or seen.value == 2


@pytest.mark.parametrize("hot", [4, 2048])
def test_op5_suffix_dedup_parts_crowded_anchors_by_longer_grams(spark, hot, monkeypatch):
    """One line of 390 bytes in 60 different surroundings, some of which repeat on one side or on both."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(16)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, before, after = some(390), [some(40) for _ in range(4)], [some(30) for _ in range(4)]
    texts = [rng.choice([*before, some(40)]) + line + rng.choice([*after, some(30)]) for _ in range(60)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in got] == brute_byte_cut(texts)


def test_op5_suffix_dedup_reads_texts_beyond_a_segment(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(26)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b = some(700), some(450)
    texts = [some(990) + a + some(1800) + b, some(40) + b + some(2950) + a + some(10), b + b, "z" * 5000]
    for words in (None, 51):
        got = suffix_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=words).orderBy("doc_id").collect()
        assert [bytes(r.kept) for r in got] == (brute_byte_cut(texts) if words is None else [t.encode() for t in brute_word_cut([t.encode() for t in texts], 51)])


@pytest.mark.parametrize("hot", [2, 2048])
def test_op5_suffix_dedup_word_windows_equal_brute_force(spark, hot, monkeypatch):
    """Words of several lengths, part words at the edges of a repeat, other white space between the same words; and the count of runs."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(36)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [words(70) for _ in range(3)]
    texts = ["", None, "a " * 200, "  ", words(51)]
    for _ in range(40):
        p = rng.choice(passages).split(" ")
        a = rng.randint(0, 25)
        p = " ".join(p[a : a + rng.randint(45, 70)])
        p = p.replace(" ", "\n", 1) if rng.random() < 0.2 else p
        texts.append(words(rng.randint(0, 30)) + rng.choice([" ", "", "\t", "x"]) + p + rng.choice([" ", "", "  ", "y"]) + words(rng.randint(0, 30)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, u0 string")
    got = suffix_dedup.deduplicate(df, words=51, result="text", passages=51).orderBy("doc_id").collect()
    assert [r.kept for r in got] == brute_word_cut([(t or "").encode() for t in texts], 51)
    assert all(r.n_passages == r.n_spans and r.u0 == "clash" for r in got) and sum(r.n_passages for r in got) > 10


def test_op10_nearest_neighbours_holds_one_block_of_queries_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12)) * 4
    x = np.concatenate([c + rng.normal(size=(60, 12)) * 0.05 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    most, made = spark.sparkContext.accumulator(0), ann._scan
    calls = spark.sparkContext.accumulator(0)

    def counted(k):
        run = made(k)

        def scan(rows, block):
            calls.add(1)
            most.add(int(len(block) > 25))
            return run(rows, block)

        return scan

    monkeypatch.setattr(ann, "_scan", counted)
    got = ann.search(df, F.col("vec_id") % 2 == 0, k=5, window=16, group_rows=40, block_queries=25).collect()
    for q in range(0, len(x), 2):
        s = ann.scores(x[q], x)
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
    assert most.value == 0 and 0 < calls.value < 9 * 8  # groups and blocks are about 9 and 8: far pairs are left out


def brute_contaminated(docs, items, cover=0.8):
    """(doc, class's least item) with the share of consistent windows, by comparing every document with every class."""
    reader = decontam.Reader()
    classes = {}
    for i, t in items:
        rows = decontam._rows_of(reader, t or "", None, None)
        if rows:
            classes.setdefault(frozenset((p, h) for p, h, _, _ in rows), []).append((i, rows))
    shorter = sorted({z for held in classes.values() for _, rows in held for *_, z in rows if z < decontam.SIZE})
    found = {}
    for d, t in docs:
        mine = decontam._rows_of(reader, t or "", None, shorter)
        for held in classes.values():
            item, rows = min(held)
            n = max(p for p, *_ in rows) + 1
            matched = set()
            for shift in {p - q for p, h, *_ in mine for q, g, *_ in rows if h == g}:
                pairs = {}
                for p, h, s, _ in mine:
                    for q, g, z, _ in rows:
                        if h == g and p - q == shift:
                            pairs[q] = max(pairs.get(q, (-1,)), (len(z), z, s))
                values = {}
                for _, z, s in pairs.values():
                    for a, b in zip(z, s, strict=True):
                        values.setdefault(a.split(":", 1)[1], set()).add(b.split(":", 1)[1])
                matched |= {q for q, (_, z, _) in pairs.items() if all(len(values[a.split(":", 1)[1]]) == 1 for a in z)}
            if len(matched) / n >= cover:
                found[d, item] = len(matched)
    return found


def test_op9_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    plain, names, units = ["the", "cart", "moves", "along", "a", "road", "and", "stops", "near", "old", "mill", "with", "seven", "bags"], ["Tom", "Mia", "Leo", "Paris", "Oslo"], ["km", "kg", "hours"]
    word = lambda: rng.choice(plain) if rng.random() < 0.6 else rng.choice(names) if rng.random() < 0.4 else f"{rng.randint(1, 40)} {rng.choice(units)}"
    item = lambda: " ".join(word() for _ in range(rng.randint(3, 22))) + rng.choice([".", "?", ""])
    items = [(k, item()) for k in range(25)]
    items += [(30, items[0][1]), (31, None), (32, "")]
    docs = []
    for k in range(70):
        t = rng.choice(items)[1] or ""
        swaps = dict(zip(names, rng.sample(names, len(names)), strict=True)) if rng.random() < 0.6 else {}
        t = " ".join(swaps.get(w, str(int(w) + 3) if w.isdigit() and rng.random() < 0.8 else w) for w in t.split())
        if rng.random() < 0.3 and t:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(plain)
            t = " ".join(w)
        docs.append((k, rng.choice(["", item() + " "]) + t + rng.choice(["", " " + item()])))
    docs += [(90, None), (91, ""), (92, "word " * 4000), (93, docs[0][1])]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contaminated(docs, items)
    assert {(r.doc_id, r.item_id): r.n_matched for r in got} == want and len(want) > 15


def test_op2_toxicity_scores_equal_the_model_text_by_text(spark):
    """Scores in tasks, whatever is remembered, are those of the model applied to each text alone; labels that conflict count as toxic."""
    rng = random.Random(21)
    words = ["".join(rng.choice(["ba", "co", "du", "fi"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + (" wretch vermin scoundrel" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, ""), (302, "\t\n"), (303, "u" * 50_000), (303, "u" * 50_000)], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("__label", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(0, 0), (1, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels, F.lit(True), sample=120)
    got = toxicity.score_texts(docs, model).select("doc_id", "text", "score").collect()
    known = model.evidence()
    for r in got:
        z = float(toxicity.summary([known[w] for w in toxicity.windows_of(r.text or "")]) @ np.array(model.weights)) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)))
    assert len(got) == 305 and len({r.score for r in got if r.doc_id in (300, 301, 302)}) == 1


def test_pipeline_on_nulls_copies_leaks_and_extra_columns(spark, tmp_path):
    rng = random.Random(31)
    words = ["".join(rng.choice(["an", "er", "ti", "on", "th", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    insult = lambda t: t.replace(" ", " vermin ", 1) + " wretched cretin vermin wretched"
    rows = [(i, insult(text(60)) if i % 4 == 0 else text(60)) for i in range(600)]
    item = "a wagon leaves the old station at noon and needs seven hours to reach the harbour town"
    passage = text(70)
    rows += [(1000, None), (1001, ""), (1002, "  "), (1003, text(9000)), (1010, rows[1][1]), (1011, rows[1][1]), (1020, f"{text(30)} {item} {text(30)}"), (1030, f"{text(40)} {passage} {text(40)}"), (1031, f"{text(50)} {passage} {text(20)}"), (1010, rows[1][1])]
    documents(spark, rows).withColumn("start", F.lit("clash")).withColumn("u0", F.lit(1.5)).withColumn("fp", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(450)] + [(None, 1, None)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, _ in rows if i % 4 and i < 600}
    assert len(clean - set(kept["toxicity"])) <= 0.02 * len(clean) and sum(i % 4 == 0 for i in kept["toxicity"] if i < 600) < 30
    near = kept["simhash_near_dedup"]
    assert len({1, 1010, 1011} & set(near)) == 1 and len({1000, 1001, 1002} & set(near)) == 1 and {1003, 1030, 1031} <= set(near)
    cut = kept["suffix_array_dedup"]
    assert passage not in cut[1030] and passage not in cut[1031] and cut[1003] == near[1003]
    assert 1020 in cut and 1020 not in kept["decontamination"] and set(cut) - {1020} == set(kept["decontamination"])
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.doc_tokens) for r in packed}
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
