"""Mined negatives against scores of all pairs, and the bounds against scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, n string, d string"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def brute(rows, positives=5, negatives=10, every=100):
    taken = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for k, (a, la, va) in enumerate(taken):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, la == lb) for j, (i, lb, v) in enumerate(taken) if j != k and len(v) == len(va)]
        for p, i, _ in sorted(s for s in scored if s[2])[:positives]:
            found = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % 100 == 0, F.expr(LABEL), **how).collect()))


def cloud(seed, n, d, spread=1.0, labels=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    m = centres[label] * spread + rng.normal(size=(n, d))
    return [(int(i), [float(x) for x in np.float32(m[i])], int(label[i]), "clash", None) for i in range(n)]


def test_all_pairs(spark):
    rows = cloud(1, 900, 24)
    rows += [(None, [1.0] * 24, 1, None, None), (1000, None, 1, "", ""), (1100, [1.0] * 23 + [None], 1, "", ""), (1200, [float("nan")] * 24, 2, "", ""), (1300, [float("inf")] * 24, 2, "", ""), (1400, [0.0] * 24, 3, "", ""), (1500, [1.0] * 24, None, "", "")]
    rows += [(1600, [1.0] * 5, 4, "", ""), (1601, [0.5] * 5, 4, "", ""), (1603, [0.25] * 5, 6, "", ""), (1700, [], 4, "", ""), (1704, [], 4, "", ""), (1702, [], 5, "", "")]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, group_rows=70, block_anchors=4) == want
    assert mined(spark, rows) == want
    assert {1600, 1700} <= {r[0] for r in want}


def test_ties_repeats_and_one_label_with_most_rows(spark):
    rows = [(i, [1.0, 0.5], 1, "", "") for i in range(0, 300)]  # a third of all rows alike
    rows += [(i, [0.5, 0.25 + i % 3], 2 if i % 2 else 1, "", "") for i in range(300, 900)]
    rows += rows[95:105] + [(100, [-3.0, -3.0], 1, "", ""), (200, [0.9, 0.9], 4, "", "")]
    want = brute(rows)
    assert want and mined(spark, rows, group_rows=64, block_anchors=2) == want


def test_empty_few_and_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, "", "")]) == []
    assert mined(spark, [(100, [1.0], 1, "", ""), (1, [1.0], 1, "", "")]) == []
    below = [(100, [1.0], 1, "", ""), (1, [-1.0], 1, "", ""), (2, [-0.5], 2, "", "")]
    assert mined(spark, below) == brute(below) == []
    zero = [(100, [1.0], 1, "", ""), (1, [0.0], 1, "", ""), (2, [0.0], 2, "", ""), (3, [0.1], 2, "", "")]
    assert mined(spark, zero) == brute(zero) == [(100, 1, 1, 2, 0, 0)]


def test_scores_that_doubles_cannot_hold():
    rows = np.array([[2.0**30 + 1, 2.0**30 + 3], [1.0, 5.0]])
    assert H.exact_scores(rows, rows[0]).tolist() == [(2**30 + 1) ** 2 + (2**30 + 3) ** 2, 2**30 + 1 + 5 * (2**30 + 3)]
    with pytest.raises(ValueError, match="SCORE_TOO_LARGE"):
        H.exact_scores(rows * 2.0**10, rows[0])


def side(m):
    means, deviations = H.summarise(m)
    return H._Side(pd.DataFrame({"n": range(len(m)), "vec_id": range(len(m)), "label": 0, "d": m.shape[1], "vec": [r.tobytes() for r in m], "summary": [np.stack([a, b]).tobytes() for a, b in zip(means, deviations, strict=True)]}))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.integers(0, 2**32 - 1), st.sampled_from([1, 300, 2**25]))
def test_bounds_hold_and_tighten(d, seed, size):
    rng = np.random.default_rng(seed)
    m = np.floor(rng.normal(size=(12, d)) * size + rng.choice([0, 5 * size]))
    m[3] = m[0]
    s = side(m)
    assert len(s.levels) == 1 + int(math.log2(min(d, H.SEGMENTS)))
    at = np.arange(len(m))
    for i in range(len(m)):
        exact, before = m @ m[i], np.inf
        for level in range(len(s.levels)):
            low, high = s.bounds(level, at, s, i)
            assert (low <= exact).all() and (exact <= high).all()
            assert (high - low <= before + 1e-6 * np.abs(exact).max() + 2).all()
            before = high - low


def test_bounds_leave_most_rows_unscored(monkeypatch):
    rng = np.random.default_rng(3)
    m = np.floor(256 * (np.repeat(rng.normal(size=(2000, 16)), 4, axis=1) + 0.05 * rng.normal(size=(2000, 64))))
    scored = []
    plain = H.exact_scores
    monkeypatch.setattr(H, "exact_scores", lambda rows, anchor: (scored.append(len(rows)), plain(rows, anchor))[1])
    s = side(m)
    at, score = H.best_of(s, s, 0, 5)
    want = sorted((-(m[i] @ m[0]), i) for i in range(1, 2000))[:5]
    assert [(int(a), int(b)) for a, b in zip(at, score, strict=True)] == [(i, -x) for x, i in want]
    assert sum(scored) < 100
