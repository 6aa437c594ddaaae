"""What the near-copy stage shuffles grows with the texts and with a group's size, not with their squares, and nothing is lost by it."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from tallywright.llm import near_copies


def near_ones(rng, n, words=8):
    """Longs of n texts: half unrelated, half in groups whose texts differ from a common one in few bits; and which are close."""
    bits = rng.random((n, 64 * words)) < 0.5
    for a in range(n // 2, n, 10):
        bits[a : a + 10] = bits[a] ^ (rng.random((len(bits[a : a + 10]), 64 * words)) < 0.08)
    s = np.packbits(bits, axis=1).view(np.int64)
    return [np.ascontiguousarray(s[:, k]) for k in range(words)], (bits[:, None] ^ bits[None]).sum(2) <= near_copies.NEAR_BITS


def test_a_text_has_as_many_keys_whatever_the_number_of_texts():
    few, many = near_copies.shape(200_000)[1], near_copies.shape(13_600_000)[1]
    assert many <= 1.1 * few and many <= 32


def test_rows_of_blocks_grow_with_the_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    made = []
    for n in (1000, 2000):
        rows = spark.range(n).selectExpr("0 AS band", "1L AS key", "id AS fp", "id AS root", "10L AS bytes")
        made.append(near_copies.in_blocks(rows).count())
    assert made[1] <= 2 * made[0] <= 2 * 16 * 1000


def test_large_buckets_are_searched_in_parts_without_loss():
    s, near = near_ones(np.random.default_rng(6), 1400)
    np.fill_diagonal(near, False)
    mine, others = near_copies.partners(s, 1)
    assert near[mine, others].all() and len(set(mine.tolist()) | set(others.tolist())) >= 0.97 * near.any(1).sum()
    root = np.arange(1400) // 5
    want = (near & (root[:, None] != root)).any(1)
    got = near_copies.apart(root, s, 1)
    assert want[got].all() and len(got) >= 0.97 * want.sum()


def test_many_open_pairs_of_a_bucket_are_told_by_what_they_connect(monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS", 1)
    s, near = near_ones(np.random.default_rng(7), 400)
    np.fill_diagonal(near, False)
    into = near_copies._Found(400)
    at = near_copies.apart(np.arange(400), s, 1, into)
    assert into.pairs is None  # 900 of 400 texts
    i, j = np.nonzero(near)
    assert sorted(at.tolist()) == sorted(set(i.tolist())) and (into.group[i] == into.group[j]).all()
    assert len(set(into.group.tolist())) == 200 + 20


def test_a_crowd_of_close_texts_that_are_mostly_not_near_gives_the_components_of_brute_force(spark):
    rng = random.Random(8)
    base, texts = [f"s{k}" for k in range(150)], []
    for _ in range(150):
        t = list(base)
        for k in rng.sample(range(150), rng.choice((1, 4, 6))):
            t[k] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert 10 < len(set(root)) < 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).select("doc_id").collect()) == sorted(set(root))
