"""Queries over events: users are runs, every event belongs to one of five candidates and ten units of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import events as E
from tallywright.plans.preparation import _RECIPE, _dirty, _folder
from tallywright.plans.register import query, read
from tallywright.streaming import live

_EV = "(SELECT event_id AS seq, user_id AS run_id, 'c' || (event_id % 5) AS candidate_id, 'u' || (event_id // 5 % 10) AS unit_id, value, CASE event_id % 7 WHEN 0 THEN 'candidate_started' WHEN 1 THEN 'candidate_completed' WHEN 2 THEN 'unit_started' WHEN 3 THEN 'candidate_failed' ELSE 'unit_completed' END AS event_type FROM events)"


def _map(e):
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "candidate_started").when(k == 1, "candidate_completed").when(k == 2, "unit_started").when(k == 3, "candidate_failed").otherwise("unit_completed")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("candidate_id"), F.concat(F.lit("u"), (F.expr("event_id div 5") % 10).cast("string")).alias("unit_id"), "value", kind.alias("event_type"))


def _events(spark, sf):
    return _map(read(spark, sf, "events"))


_DONE = "event_type = 'unit_completed'"


@query("unit_progress", f"SELECT run_id, candidate_id, count(DISTINCT unit_id) AS completed_units FROM {_EV} WHERE {_DONE} GROUP BY 1, 2")
def unit_progress(spark, sf):
    twice = _events(spark, sf)
    return E.unit_progress(twice.unionByName(twice.where(F.col("seq") % 3 == 0)))


_LIVE = f"SELECT run_id, candidate_id, CASE arg_max(event_type, seq) FILTER (WHERE event_type LIKE 'candidate%') WHEN 'candidate_started' THEN 'running' WHEN 'candidate_completed' THEN 'completed' WHEN 'candidate_failed' THEN 'failed' END AS status, CASE WHEN arg_max(event_type, seq) FILTER (WHERE event_type LIKE 'unit%') = 'unit_started' THEN arg_max(unit_id, seq) FILTER (WHERE event_type LIKE 'unit%') END AS active_unit, count(DISTINCT unit_id) FILTER (WHERE {_DONE}) AS completed_units, arg_max(value, seq) FILTER (WHERE {_DONE}) AS latest_value, max(seq) AS last_seq FROM {_EV} GROUP BY 1, 2"


@query("live_state", _LIVE)
def live_state(spark, sf):
    return E.live_state(_events(spark, sf))


def _end_state(spark, stream, keys, name):
    """Runs a stream over all that is there; the last update of each key is its state."""
    out, checkpoint = _folder(spark, name), _folder(spark, f"{name}-checkpoint")
    write = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(out)
    return states.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in states.columns if c not in (*keys, "batch")]), F.struct("last_seq", "batch")).alias("s")).select(*keys, "s.*")


def _event_stream(spark, sf):
    return live.with_state_store(spark).readStream.schema(read(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")


@query("live_state_stream", _LIVE)
def live_state_stream(spark, sf):
    """The same fold as a stream."""
    return _end_state(spark, live.live_state_stream(_map(_event_stream(spark, sf))), ["run_id", "candidate_id"], "live")


@query("event_replay", f"SELECT * FROM {_EV} WHERE seq > 500 ORDER BY seq LIMIT 200")
def event_replay(spark, sf):
    return E.replay(_events(spark, sf), 500)


@query("recent_events", f"SELECT run_id, seq, event_type, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) AS INTEGER) AS place FROM (SELECT * FROM {_EV} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 50)")
def recent_events(spark, sf):
    return E.recent(_events(spark, sf)).select("run_id", "seq", "event_type", "place")


@query("progress_counters", f"SELECT run_id, count(DISTINCT candidate_id) FILTER (WHERE event_type = 'candidate_completed') AS completed_candidates, CAST(5 AS BIGINT) AS eligible_candidates, count(DISTINCT candidate_id || unit_id) FILTER (WHERE {_DONE}) AS completed_evaluations, CAST(50 AS BIGINT) AS planned_evaluations FROM {_EV} GROUP BY 1")
def progress_counters(spark, sf):
    events = _events(spark, sf)
    planned = events.select("run_id").distinct().select("run_id", F.lit(5).cast("long").alias("eligible_candidates"), F.lit(50).cast("long").alias("planned_evaluations"))
    return E.progress(events, planned)


@query("stream_clean", "SELECT c_custkey, c_custkey % 17 = 0 OR c_mktsegment = 'MACHINERY' AS rejected FROM customer")
def stream_clean(spark, sf):
    """The recipe of ``apply_recipe`` over a stream of the same rows; both sinks read back."""
    source_path, clean, bad = _folder(spark, "stream-in"), _folder(spark, "stream-clean"), _folder(spark, "stream-bad")
    dirty = _dirty(spark, sf)
    dirty.write.parquet(source_path)
    source = spark.readStream.schema(dirty.schema).parquet(source_path)
    live.clean_stream(source, _RECIPE, "c_custkey", clean, bad, _folder(spark, "stream-checkpoint")).awaitTermination()
    kept = spark.read.parquet(clean).select("c_custkey", F.lit(False).alias("rejected"))
    return kept.unionByName(spark.read.parquet(bad).select(F.col("row_id").alias("c_custkey"), F.lit(True).alias("rejected")))


# fixed values: the kind of each event of the full fold, by its number
_KINDS = ("candidate_started", "candidate_completed", "unit_started", "unit_completed", "candidate_failed", "primary_selection_completed", "confirmation_started", "confirmation_completed", "selection_completed", "final_test_completed", "snapshot_frozen")
_FULL = "(SELECT event_id AS seq, user_id AS run_id, 'c' || (event_id % 5) AS candidate_id, 'u' || (event_id // 5 % 10) AS unit_id, value, event_id % 5 AS complexity, CAST(event_id AS VARCHAR) AS payload, CASE event_id % 11 " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(_KINDS)) + " END AS event_type FROM events)"


def _full_map(e):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("seq") % 11 + 1).cast("int"))
    return _map(e).withColumn("event_type", kind).withColumn("complexity", F.col("seq") % 5).withColumn("payload", F.col("seq").cast("string"))


def _full(spark, sf):
    return _full_map(read(spark, sf, "events"))


def _last(what, kinds):
    return f"arg_max({what}, seq) FILTER (WHERE event_type IN ({', '.join(repr(k) for k in kinds)}))"


_UNITS = ("unit_started", "unit_completed", "confirmation_unit_completed")


_RUN_STATE = (
    f"WITH e AS (SELECT * FROM {_FULL}), s AS (SELECT run_id, {_last('candidate_id', ('candidate_started', *_UNITS))} AS active_candidate, {_last('unit_id', _UNITS)} AS active_unit, {_last('payload', ('primary_selection_completed',))} AS primary_decision, "
    f"{_last('payload', ('confirmation_started', 'confirmation_completed'))} AS confirmation, coalesce({_last('event_type', ('confirmation_started', 'confirmation_completed'))} = 'confirmation_started', false) AS confirming, {_last('payload', ('selection_completed',))} AS decision, {_last('payload', ('final_test_completed',))} AS final_test, "
    f"{_last('payload', ('snapshot_frozen',))} AS summary, max(seq) AS last_seq FROM e GROUP BY 1), w AS (SELECT run_id, candidate_id, {_last('event_type', ('candidate_started', 'candidate_completed', 'candidate_failed'))} AS word, arg_max(value, seq) FILTER (WHERE event_type = 'candidate_completed') AS v, max(complexity) AS c FROM e GROUP BY 1, 2), "
    "r AS (SELECT run_id, string_agg(candidate_id, ',' ORDER BY v, c, candidate_id) AS ranking FROM w WHERE word = 'candidate_completed' GROUP BY 1) SELECT s.*, coalesce(ranking, '') AS ranking FROM s LEFT JOIN r USING (run_id)"
)


@query("run_state", _RUN_STATE)
def run_state(spark, sf):
    return E.run_state(_full(spark, sf)).withColumn("ranking", F.concat_ws(",", "ranking"))


@query("run_state_stream", _RUN_STATE)
def run_state_stream(spark, sf):
    """The same fold as a stream: ranking, decisions, confirmation and the rest of a run's state."""
    return _end_state(spark, live.run_state_stream(_full_map(_event_stream(spark, sf)), keep_ms=0), ["run_id"], "runs").withColumn("ranking", F.concat_ws(",", "ranking"))


@query("event_replay_terminal", f"SELECT *, run_id % 3 <> 0 AS terminal FROM {_EV} WHERE seq > 500 ORDER BY seq LIMIT 200")
def event_replay_terminal(spark, sf):
    events = _events(spark, sf)
    ended = F.when(F.col("run_id") % 3 == 0, "running").when(F.col("run_id") % 3 == 1, "succeeded").otherwise("failed")
    return E.replay_run(events, events.select("run_id").distinct().withColumn("status", ended), 500)
