"""Streams of events against the same folds over whole tables."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.operators import events
from tallywright.plans.events import _end_state
from tallywright.streaming import live

SCHEMA = "run_id long, seq long, event_type string, candidate_id string, unit_id string, value double, complexity int, payload string"
KINDS = ("candidate_started", *["candidate_completed"] * 6, "candidate_failed", "candidate_skipped", "unit_started", "unit_completed", "unit_completed", "confirmation_unit_completed", "primary_selection_completed", "confirmation_started", "confirmation_completed", "selection_completed", "final_test_completed", "snapshot_frozen", "other")


def log(seed, n):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(k % 3, k, rng.choice(KINDS), pick(*"abcdefg", None), pick("u1", "u2", "u3", None), pick(None, 0.5, 0.5, -1.0, 2.0), pick(None, 1, 2), pick(None, "p", "q")) for k in range(n)]


@pytest.fixture
def stream(spark, tmp_path):
    """Events in three files, a batch each: out of order, with replays over batches and within them."""
    rows = log(5, 400)
    rng = random.Random(6)
    for k in range(3):
        part = rows[k::3] + rng.sample(rows[: 150 * (k + 1)], 60)
        rng.shuffle(part)
        spark.createDataFrame(part + part[:9], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.createDataFrame(rows, SCHEMA)
    return table, live.with_state_store(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def as_sets(df):
    return {tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()}


def test_live_state_of_a_stream(spark, stream):
    table, source = stream
    got = _end_state(spark, live.live_state_stream(source), ["run_id", "candidate_id"], "t1")
    assert as_sets(got) == as_sets(events.live_state(table))


def test_run_state_of_a_stream(spark, stream):
    (table, source), direction = stream, "max"
    got = _end_state(spark, live.run_state_stream(source, direction, keep_ms=0), ["run_id"], "t2")
    want = events.run_state(table, direction)
    assert as_sets(got) == as_sets(want) and want.where(F.size("ranking") > 1).count() > 0


class Held:
    """State of one key, as a store keeps it."""

    def __init__(self):
        self.entries = {}

    def exists(self):
        return bool(self.entries)

    def get(self):
        return self.entries.get(None)

    def update(self, value):
        self.entries[None] = value

    def containsKey(self, key):
        return key in self.entries

    def getValue(self, key):
        return self.entries[key]

    def updateValue(self, key, value):
        self.entries[key] = value

    def iterator(self):
        return iter(list(self.entries.items()))

    def clear(self):
        self.entries = {}


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Held())

    def getMapState(self, name, key, schema):
        return self.getValueState(name, schema)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_an_ended_run_is_cleared_and_its_replay_is_old():
    handle, fold = Handle(), live.RunFold("min", 50)
    fold.init(handle)
    rows = pd.DataFrame(log(1, 30), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    rows.loc[29, "event_type"] = "snapshot_frozen"
    (first,) = fold.handleInputRows((0,), iter([rows]), handle)
    assert first["last_seq"][0] == 29 and handle.timers and set(handle.timers) == {1050}
    assert list(fold.handleExpiredTimer((0,), handle, None)) == []
    assert {n: len(h.entries) for n, h in handle.states.items()} == {"slots": 0, "words": 0, "cleared": 1}
    assert list(fold.handleInputRows((0,), iter([rows]), handle)) == []
    later = rows.assign(seq=rows["seq"] + 100)
    (again,) = fold.handleInputRows((0,), iter([later]), handle)
    assert again["last_seq"][0] == 129
