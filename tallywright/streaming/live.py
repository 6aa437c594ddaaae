"""Stream forms: the live state of candidates and runs folded from an event stream, and row-wise cleaning of a stream into two sinks.

The folds keep what they know in state of Spark's own: one value a key, read and written once for all events of a batch (each call is a
message to Spark), with the first ``INSIDE`` units or candidates in it. Those beyond have an entry each in a map, so that the value stays
small and an event touches its own entries only. Every slot remembers the number of the event that it is from, and only a
later event changes it: replayed events change nothing, and events may come in any order. The state store must be RocksDB's
(``with_state_store`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallywright.operators.events import CONFIRMATIONS, SLOTS, UNITS, WORDS
from tallywright.operators.recipe import Recipe, compile_rows

OUTPUT = "run_id long, candidate_id string, status string, active_unit string, completed_units long, latest_value double, last_seq long"
RUN_OUTPUT = "run_id long, active_candidate string, active_unit string, primary_decision string, confirmation string, confirming boolean, decision string, final_test string, summary string, last_seq long, ranking array<string>"
# fixed values: what an event says about its candidate
STATUS = {"candidate_started": "running", "candidate_completed": "completed", "candidate_failed": "failed"}
INSIDE = 64  # units or candidates that a key's value holds itself
KEEP_MS = 3_600_000  # how long the state of an ended run stays


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _text(x: object) -> str | None:
    return None if x is None or isinstance(x, float) else str(x)


def _number(x: object) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def _names(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(",")]


def _cells(rows: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple]:
    for pdf in rows:
        yield from zip(*[pdf[c].tolist() for c in columns], strict=True)


def _frames(states: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    for state in states:
        yield pd.DataFrame({c: [v] for c, v in zip(_names(schema), state, strict=True)})


class CandidateFold(StatefulProcessor):
    """A candidate's state: its last status, unit and value and its first completed units in a single value; a map entry for each further one."""

    READS = ("event_type", "seq", "unit_id", "value")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "status string, status_seq long, active string, unit_seq long, value double, value_seq long, last_seq long, done long, inside array<string>")
        self.units = handle.getMapState("units", "unit_id string", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.fold(key, _cells(rows, self.READS)), OUTPUT)

    def fold(self, key: tuple, events: Iterator[tuple]) -> Iterator[tuple]:
        status, status_seq, active, unit_seq, value, value_seq, last, done, inside = self.known.get() or (None, -1, None, -1, None, -1, -1, 0, ())
        inside, met = list(inside), {}
        for kind, seq, unit, v in events:
            last, unit = max(last, seq), _text(unit)
            if kind in STATUS and seq > status_seq:
                status, status_seq = STATUS[kind], seq
            if kind in ("unit_started", "unit_completed") and seq > unit_seq:
                active, unit_seq = (unit if kind == "unit_started" else None), seq
            if kind == "unit_completed":
                if unit is not None:
                    met.setdefault(unit, seq)
                if seq > value_seq:
                    value, value_seq = _number(v), seq
        for unit in inside:
            met.pop(unit, None)
        for unit, seq in met.items():
            if done > len(inside) and self.units.containsKey((unit,)):
                continue
            if len(inside) < INSIDE:
                inside.append(unit)
            else:
                self.units.updateValue((unit,), (seq,))
            done += 1
        self.known.update((status, status_seq, active, unit_seq, value, value_seq, last, done, inside))
        yield key[0], key[1], status, active, done, value, last

    def close(self) -> None:
        pass


class CandidateRows(CandidateFold):
    """The fold on rows instead of a pandas table for each key, which costs more than what most keys have to fold."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for state in self.fold(key, (tuple(r[c] for c in self.READS) for r in rows)):
            yield Row(**dict(zip(_names(OUTPUT), state, strict=True)))


def live_state_stream(events: DataFrame) -> DataFrame:
    """A stream of events (run_id, candidate_id, seq, event_type, unit_id, value) → updated states, as ``operators.events.live_state`` has
    them of all events so far. A completion without a unit counts for its value only."""
    known = events.where(F.col("candidate_id").isNotNull()).select("run_id", "candidate_id", "seq", "event_type", "unit_id", "value")
    return known.groupBy("run_id", "candidate_id").transformWithState(CandidateRows(), OUTPUT, "Update", "None")


class RunFold(StatefulProcessor):
    """A run's state: slots by name and the last words of its first candidates in a single value; a map entry for each further candidate.
    ``direction``: whether small or large is better."""

    READS = ("event_type", "seq", "candidate_id", "unit_id", "value", "complexity", "payload")

    def __init__(self, direction: str, keep_ms: int) -> None:
        self.direction, self.keep_ms = direction, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        word = "seq: long, event_type: string, value: double, complexity: long"
        self.slots = handle.getValueState("slots", f"cleared long, slots array<struct<name: string, seq: long, text: string>>, inside array<struct<candidate_id: string, {word}>>, outside long")
        self.words = handle.getMapState("words", "candidate_id string", word.replace(":", ""))
        self.cleared = handle.getValueState("cleared", "last_seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _frames(self.fold(key, _cells(rows, self.READS), timerValues), RUN_OUTPUT)

    def fold(self, key: tuple, events: Iterator[tuple], timerValues) -> Iterator[tuple]:
        before, slots, inside, outside = self.slots.get() or (*(self.cleared.get() or (-1,)), (), (), 0)
        slots = {name: (seq, text) for name, seq, text in slots}
        inside = {candidate: tuple(word) for candidate, *word in inside}
        words: dict[str, tuple] = {}
        some, ended = False, False

        def put(name: str, seq: int, text: str | None) -> None:
            if seq > slots.get(name, (-1, None))[0]:
                slots[name] = (seq, text)

        for kind, seq, candidate, unit, v, complexity, payload in events:
            if seq <= before:  # what a cleared run has seen is old
                continue
            some, candidate, unit, payload = True, _text(candidate), _text(unit), _text(payload)
            put("last_seq", seq, None)
            if kind == "candidate_started" or kind in UNITS:
                put("active_candidate", seq, candidate)
            if kind in UNITS:
                put("active_unit", seq, unit)
            if kind in CONFIRMATIONS:
                put("confirming", seq, kind)
            for name, kinds in SLOTS.items():
                if kind in kinds:
                    put(name, seq, payload)
                    ended = ended or name == "summary"
            if candidate is not None and kind in WORDS and seq > words.get(candidate, (-1,))[0]:
                words[candidate] = (seq, kind, _number(v), None if pd.isna(complexity) else int(complexity))
        if not some:
            return
        for candidate, word in words.items():
            held = inside.get(candidate)
            if held is None and outside:
                held = self.words.getValue((candidate,)) if self.words.containsKey((candidate,)) else None
            if held is not None and word[0] <= held[0]:
                continue
            if candidate in inside or (held is None and len(inside) < INSIDE):
                inside[candidate] = word
            else:
                outside += held is None
                self.words.updateValue((candidate,), word)
        self.slots.update((before, [(name, *slot) for name, slot in slots.items()], [(candidate, *word) for candidate, word in inside.items()], outside))
        if self.keep_ms and ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        further = ((k[0], *word) for k, word in self.words.iterator()) if outside else ()
        yield self._row(key, slots, [*((candidate, *word) for candidate, word in inside.items()), *further])

    def _row(self, key: tuple, known: dict[str, tuple], words: list[tuple]) -> tuple:
        sign = -1.0 if self.direction == "max" else 1.0
        done = [(sign * v, 999 if c is None else c, candidate) for candidate, _, kind, v, c in words if kind == "candidate_completed" and v is not None]
        text = lambda name: known[name][1] if name in known else None
        row = {"run_id": key[0], **{c: text(c) for c in ("active_candidate", "active_unit", *SLOTS)}}
        row |= {"confirming": text("confirming") == "confirmation_started", "last_seq": known["last_seq"][0], "ranking": [c for *_, c in sorted(done)]}
        return tuple(row[c] for c in _names(RUN_OUTPUT))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """An ended run keeps the number of its last event only."""
        last = next((seq for name, seq, _ in (self.slots.get() or (-1, ()))[1] if name == "last_seq"), None)
        if last is not None:
            self.cleared.update((last,))
            self.slots.clear()
            self.words.clear()
        return iter(())

    def close(self) -> None:
        pass


class RunRows(RunFold):
    """The fold on rows."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for state in self.fold(key, (tuple(r[c] for c in self.READS) for r in rows), timerValues):
            yield Row(**dict(zip(_names(RUN_OUTPUT), state, strict=True)))


def run_state_stream(events: DataFrame, direction: str = "min", keep_ms: int = KEEP_MS) -> DataFrame:
    """A stream of events (run_id, seq, event_type, candidate_id, unit_id, value, complexity, payload) → a run's updated state, as
    ``operators.events.run_state`` has it of all events so far. ``keep_ms`` after a run's snapshot its state is cleared (0: never). Timers
    make batches without end, so a stream that is to end by itself (``availableNow``) takes 0."""
    known = events.select("run_id", "seq", "event_type", "candidate_id", "unit_id", "value", F.col("complexity").cast("long").alias("complexity"), "payload")
    return known.groupBy("run_id").transformWithState(RunRows(direction, keep_ms), RUN_OUTPUT, "Update", "ProcessingTime" if keep_ms else "None")


def clean_stream(df: DataFrame, recipe: Recipe, row_id: str, clean_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Apply a recipe's row-wise part to a stream: kept rows to one Parquet sink, rejected to another. Duplicates need state without
    bound and monthly sums need all rows, so recipes with either are refused."""
    if recipe.drop_duplicates or recipe.monthly:
        raise ValueError("NOT_ROW_WISE")
    if any(r.invalid == "block" and r.type in ("numeric", "date") for r in recipe.columns):
        raise ValueError("BLOCK_NEEDS_A_WHOLE_TABLE")
    rows = compile_rows(df, recipe)
    kept = F.lit(True)
    for f in recipe.filters:
        kept = kept & f.keeps()
    rows = rows.withColumn("kept", kept & F.col("bad_column").isNull())

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("kept").select(*df.columns).write.mode("overwrite").parquet(f"{clean_path}/batch={number}")
        batch.where("not kept").select(F.col(row_id).alias("row_id"), F.coalesce("bad_column", F.lit("filter")).alias("column_id")).write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
