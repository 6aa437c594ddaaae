"""Folding an append-only event log: progress, live state, replay. The stream form is in tallywright.streaming.live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_progress(events: DataFrame) -> DataFrame:
    """run_id, candidate_id, completed_units: a unit completed twice counts once."""
    done = events.where((F.col("event_type") == "unit_completed") & F.col("unit_id").isNotNull())
    return done.groupBy("run_id", "candidate_id").agg(F.count_distinct("unit_id").alias("completed_units"))


def live_state(events: DataFrame) -> DataFrame:
    """run_id, candidate_id, status, active_unit, completed_units, latest_value, last_seq: each candidate's state after all events."""
    kind, seq = F.col("event_type"), F.col("seq")
    status = F.when(kind == "candidate_started", "running").when(kind == "candidate_completed", "completed").when(kind == "candidate_failed", "failed")
    unit = kind.isin("unit_started", "unit_completed")
    return events.where(F.col("candidate_id").isNotNull()).groupBy("run_id", "candidate_id").agg(
        F.max_by(status, F.when(status.isNotNull(), seq)).alias("status"),
        F.max_by(F.when(kind == "unit_started", F.col("unit_id")), F.when(unit, seq)).alias("active_unit"),
        F.count_distinct(F.when(kind == "unit_completed", F.col("unit_id"))).alias("completed_units"),
        F.max_by("value", F.when(kind == "unit_completed", seq)).alias("latest_value"),
        F.max("seq").alias("last_seq"),
    )


def replay(events: DataFrame, after: int, limit: int = 200) -> DataFrame:
    """The next events past a cursor, in order: 1 to 200 of them."""
    if not 1 <= limit <= 200:
        raise ValueError("LIMIT_OUT_OF_RANGE")
    return events.where(F.col("seq") > after).orderBy("seq").limit(limit)


def recent(events: DataFrame, n: int = 50) -> DataFrame:
    """The last n events of each run, with their place in ascending order."""
    w = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    last = events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).drop("back")


def progress(events: DataFrame, planned: DataFrame) -> DataFrame:
    """run_id, completed_candidates, eligible_candidates, completed_evaluations, planned_evaluations. ``planned``: run_id,
    eligible_candidates, planned_evaluations."""
    done = events.groupBy("run_id").agg(F.count_distinct(F.when(F.col("event_type") == "candidate_completed", F.col("candidate_id"))).alias("completed_candidates"), F.count_distinct(F.when(F.col("event_type") == "unit_completed", F.struct("candidate_id", "unit_id"))).alias("completed_evaluations"))
    return planned.join(done, "run_id", "left").select("run_id", F.coalesce("completed_candidates", F.lit(0)).cast("long").alias("completed_candidates"), "eligible_candidates", F.coalesce("completed_evaluations", F.lit(0)).cast("long").alias("completed_evaluations"), "planned_evaluations")


# fixed values: statuses of a run that has ended
TERMINAL = ("succeeded", "succeeded_with_warnings", "failed", "cancelled", "interrupted")


def replay_run(events: DataFrame, runs: DataFrame, after: int, limit: int = 200) -> DataFrame:
    """As ``replay``, with ``terminal``: whether the event's run (``runs``: run_id, status) has ended, so that no more will come."""
    ended = runs.select("run_id", F.col("status").isin(*TERMINAL).alias("terminal"))
    return replay(events, after, limit).join(ended, "run_id", "left").withColumn("terminal", F.coalesce("terminal", F.lit(False)))


# fixed values: the kinds of events that a run's state is told from
UNITS = ("unit_started", "unit_completed", "confirmation_unit_completed")
WORDS = ("candidate_started", "candidate_completed", "candidate_failed", "candidate_skipped")
CONFIRMATIONS = ("confirmation_started", "confirmation_completed")
SLOTS = {"primary_decision": ("primary_selection_completed",), "confirmation": CONFIRMATIONS, "decision": ("selection_completed",), "final_test": ("final_test_completed",), "summary": ("snapshot_frozen",)}


def run_state(events: DataFrame, direction: str = "min") -> DataFrame:
    """run_id, active_candidate, active_unit, primary_decision, confirmation, confirming, decision, final_test, summary, last_seq, ranking:
    a run's state after all events (run_id, seq, event_type, candidate_id, unit_id, value, complexity, payload). The last event of a
    kind holds; the ranking has the candidates whose last word is a completion with a value (NaN is none), best first, ties to the
    simpler one, then by id."""
    kind, seq = F.col("event_type"), F.col("seq")
    last = lambda what, *kinds: F.max_by(what, F.when(kind.isin(*kinds), seq))
    states = events.groupBy("run_id").agg(
        last(F.col("candidate_id"), "candidate_started", *UNITS).alias("active_candidate"),
        last(F.col("unit_id"), *UNITS).alias("active_unit"),
        *[last(F.col("payload"), *kinds).alias(name) for name, kinds in SLOTS.items()],
        F.coalesce(last(kind == "confirmation_started", *CONFIRMATIONS), F.lit(False)).alias("confirming"),
        F.max("seq").alias("last_seq"),
    )
    sign = -1.0 if direction == "max" else 1.0
    said = events.where(F.col("candidate_id").isNotNull()).groupBy("run_id", "candidate_id").agg(last(F.struct("event_type", "value", "complexity"), *WORDS).alias("word"))
    done = said.where((F.col("word.event_type") == "candidate_completed") & F.col("word.value").isNotNull() & ~F.isnan("word.value"))
    order = F.struct((F.col("word.value") * sign).alias("v"), F.coalesce("word.complexity", F.lit(999)).alias("c"), "candidate_id")
    ranking = done.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["candidate_id"]).alias("ranking"))  # a run's candidates
    return states.join(ranking, "run_id", "left").withColumn("ranking", F.coalesce("ranking", F.array().cast("array<string>")))
