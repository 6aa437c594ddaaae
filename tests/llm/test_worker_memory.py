"""What a Python worker holds, and gives back."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tallywright.llm import common, packing


def test_cuts_are_chosen_without_an_object_for_each():
    cuts = np.arange(0, 64 * 100_000, 64)  # each has one at a half, a quarter and an eighth of a window before it
    penalty = np.full(len(cuts), 2.0)
    tracemalloc.start()
    chosen = packing.best_cuts(cuts, penalty, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chosen) == -(-(len(cuts) - 1) // 16) + 1
    assert peak < 200 * len(cuts)  # 408 bytes a cut with a tuple for each, 85 without


def test_a_worker_returns_what_the_task_before_held(monkeypatch):
    returned = []
    monkeypatch.setattr(common, "release", lambda: returned.append(1), raising=True)
    monkeypatch.setattr(common, "_kept", {})
    first = common.kept("one kind", list)
    assert common.kept("one kind", list) is first and not returned
    common.kept("another kind", dict)
    assert returned and set(common._kept) == {"another kind"}
