"""Crowded buckets and large benchmarks are parted, with the results unchanged."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallywright.llm import decontam, near_copies, toxicity


def test_every_two_texts_of_a_bucket_meet_once_in_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rows = [(0, 1, k, k, 10) for k in range(100)] + [(1, 5, k, k, 9_000_000) for k in range(7)] + [(2, 5, 1, 1, 10), (2, 5, 2, 2, 10)]
    placed = near_copies.in_blocks(spark.createDataFrame(rows, "band int, key long, fp long, root long, bytes long")).collect()
    groups: dict[tuple, list] = {}
    for r in placed:
        groups.setdefault((r.band, r.key, r.i, r.j), []).append(r)
    met = Counter()
    for (band, _key, i, j), members in groups.items():
        assert len(members) <= 4 * 8
        assert i < j or all(r.side == 0 for r in members)
        met.update((band, *sorted((a.fp, b.fp))) for a, b in combinations(members, 2) if i == j or a.side != b.side)
    assert met == Counter((b, *p) for b, n in ((0, range(100)), (1, range(7)), (2, (1, 2))) for p in combinations(n, 2))
    assert len({r.i for r in placed if r.band == 1}) > 1  # long texts part a bucket of few


@pytest.mark.parametrize("block", [1, 256])
def test_one_crowded_bucket_gives_the_components_of_brute_force(spark, monkeypatch, block):
    """A stock of words that all texts share, so that they crowd in buckets without being near, and a chain of near copies."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    stock = [f"s{k}" for k in range(60)]
    texts = [" ".join(stock + [f"w{rng.randrange(10**6)}" for _ in range(25)]) for _ in range(12)]
    chain = (stock + [f"c{k}" for k in range(60)]) * 1
    for k in range(8):
        chain = [*chain[: 119 - 4 * k], f"n{k}", *chain[120 - 4 * k :]]
        texts.append(" ".join(chain))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).select("doc_id").collect()) == sorted(set(root))


def test_large_benchmarks_are_looked_up_in_a_bitmap(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ado", "eri", "ilu", "omo", "uki")]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(30)]
    texts = [(k, " ".join(rng.choices(words, k=30)) + (" " + items[k % 30][1] if k % 3 == 0 else "")) for k in range(60)] + [(60, None), (61, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    listed = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "MOST_LOOKED_UP", 0)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == listed
    assert {r[0] for r in listed} >= set(range(0, 60, 3))
    windows = spark.range(5000).select(F.xxhash64("id").alias("window"))
    found, hashes = decontam.looked_up(windows), windows.toPandas()["window"].to_numpy().view("uint64")
    assert found.holds(hashes).all()
    assert found.holds(hashes ^ decontam._U(0x5555555555555555)).mean() < 0.01


def test_the_sample_stays_within_its_bytes_and_counts_equal_rows_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(toxicity, "fit", lambda bad, good: seen.update(bad=bad, good=good))
    docs = spark.range(100).selectExpr("id AS doc_id", "repeat('x', 90) || id AS text").unionByName(spark.range(5000).selectExpr("3L AS doc_id", "'same' AS text"))
    docs = docs.unionByName(spark.range(4).selectExpr("id AS doc_id", "repeat('y', 5000) AS text")).unionByName(spark.range(1).selectExpr("CAST(NULL AS bigint) AS doc_id", "'z' AS text"))
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    toxicity.fit_on(docs, labels, F.lit(True))
    for texts, rest in ((seen["bad"], 1), (seen["good"], 0)):
        assert 0 < sum(map(len, texts)) <= 1000
        assert len(texts) == len(set(texts)) >= 9
        assert all(t == "same" or int(t[90:]) % 2 == rest for t in texts)
