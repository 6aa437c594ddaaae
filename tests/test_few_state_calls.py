"""The streams' folds ask Spark for a key's state once for a batch, and keep more units and candidates than a value holds."""

import pandas as pd

from tallywright.streaming import live


class _State:
    def __init__(self, calls):
        self.calls, self.kept, self.entries = calls, None, {}

    def get(self):
        self.calls.append("get")
        return self.kept

    def update(self, value):
        self.calls.append("update")
        self.kept = value

    def containsKey(self, key):
        self.calls.append("containsKey")
        return key in self.entries

    def getValue(self, key):
        self.calls.append("getValue")
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.calls.append("updateValue")
        self.entries[key] = value

    def iterator(self):
        return iter(self.entries.items())


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):
        return _State(self.calls)

    getMapState = getValueState


def _fed(fold, key, batches):
    handle = _Handle()
    fold.init(handle)
    for batch in batches:
        handle.calls.clear()
        out = list(fold.handleInputRows(key, iter([pd.DataFrame(batch)]), None))
    return out[0].iloc[0], list(handle.calls)


def _units(numbers):
    return [{"event_type": "unit_completed", "seq": n, "unit_id": f"u{n}", "value": float(n)} for n in numbers]


def test_a_candidates_units():
    row, calls = _fed(live.CandidateFold(), (1, "c"), [_units(range(50)), _units(range(40, 60))])
    assert row.completed_units == 60 and row.latest_value == 59.0 and calls == ["get", "update"]
    row, _ = _fed(live.CandidateFold(), (1, "c"), [_units(range(live.INSIDE + 30)), _units(range(live.INSIDE + 40)), _units(range(5))])
    assert row.completed_units == live.INSIDE + 40 and row.last_seq == live.INSIDE + 39


def _words(numbers, kind="candidate_completed", shift=0):
    return [{"event_type": kind, "seq": n + shift, "candidate_id": f"c{n:03}", "unit_id": None, "value": -float(n), "complexity": 1, "payload": None} for n in numbers]


def test_a_runs_candidates():
    row, calls = _fed(live.RunFold("min", 0), (1,), [_words(range(20)), _words(range(20))])
    assert row.ranking == [f"c{n:03}" for n in reversed(range(20))] and calls == ["get", "update"]
    n = live.INSIDE + 20
    row, _ = _fed(live.RunFold("min", 0), (1,), [_words(range(n)), _words([3, n - 1], "candidate_failed", 1000), _words([n - 1])])
    assert row.ranking == [f"c{k:03}" for k in reversed(range(n)) if k not in (3, n - 1)] and row.last_seq == 1000 + n - 1
