"""The selection policy: paired units, practical thresholds, consistency, and the choice of the simplest good candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def improvement(candidate: Column, baseline: Column, direction: str) -> Column:
    return candidate - baseline if direction == "max" else baseline - candidate


def thresholds(metric: str, baseline: Column, scale: Column) -> Column:
    """Struct (tie, gain, eps): what counts as equal, as a practical gain, and as zero."""
    if metric in ("mae", "rmse"):
        level = F.greatest(F.lit(0.0), baseline)
        tie, gain = level * 0.01, level * 0.03
    elif metric == "r2":
        tie, gain = F.lit(0.01), F.lit(0.02)
    else:
        tie, gain = F.lit(0.005), F.lit(0.02)
    return F.struct(tie.alias("tie"), gain.alias("gain"), F.greatest(F.lit(1e-12), scale * 1e-12).alias("eps"))


def pair_units(unit_metrics: DataFrame, baseline: DataFrame, direction: str, keys: list[str] | None = None) -> DataFrame:
    """keys, candidate_id, unit_id, value, baseline_value, gain, reason for each unit of each candidate. ``unit_metrics``: keys,
    candidate_id, unit_id, value; ``baseline``: keys, candidate_id of the reference."""
    keys = keys or []
    base = unit_metrics.join(baseline.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_semi").select(*keys, "unit_id", F.col("value").alias("baseline_value"), F.lit(True).alias("matched"))
    joined = unit_metrics.join(base, [*keys, "unit_id"], "left")
    reason = F.when(F.col("matched").isNull(), "UNMATCHED_UNIT").when(F.col("value").isNull(), "CANDIDATE_UNDEFINED").when(F.col("baseline_value").isNull(), "BASELINE_UNDEFINED")
    return joined.select(*keys, "candidate_id", "unit_id", "value", "baseline_value", F.when(reason.isNull(), improvement(F.col("value"), F.col("baseline_value"), direction)).alias("gain"), reason.alias("reason"))


def rank_candidates(candidates: DataFrame, direction: str, keys: list[str] | None = None) -> DataFrame:
    """Completed candidates by value, then complexity, then id."""
    value = F.desc("primary_value") if direction == "max" else F.asc("primary_value")
    done = candidates.where((F.col("status") == "completed") & F.col("primary_value").isNotNull())
    return done.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value, "complexity", "candidate_id")))


def judge_candidates(candidates: DataFrame, unit_metrics: DataFrame, baseline: DataFrame, metric: str, direction: str, target_scale: Column | float = 1.0, blocked: Column | bool = False, keys: list[str] | None = None) -> DataFrame:
    """A row per candidate: joint gain, pairs, wins, median gain, passes, reason, and the thresholds used.

    A candidate passes when it and the baseline are complete, the baseline's error isn't about zero, the joint gain reaches the least
    practical gain, at least three units pair, it wins over 60 % of them (rounded up) and the median gain is positive."""
    keys = keys or []
    scale = F.lit(target_scale) if isinstance(target_scale, (int, float)) else target_scale
    stop = F.lit(blocked) if isinstance(blocked, bool) else blocked
    base = candidates.join(baseline.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_semi").select(*keys, F.col("candidate_id").alias("baseline_id"), F.col("primary_value").alias("baseline_value"), (F.col("status") == "completed").alias("baseline_done"))
    pairs = pair_units(unit_metrics, baseline, direction, keys)
    with_base = candidates.join(base, keys) if keys else candidates.join(base, F.lit(True))
    eps = F.greatest(F.lit(1e-12), F.abs(scale) * 1e-12)
    won = pairs.groupBy(*keys, "candidate_id").agg(F.count("gain").alias("pairs"), F.median("gain").alias("median_gain"), F.collect_list("gain").alias("gains"))
    j = with_base.join(won, [*keys, "candidate_id"], "left").withColumn("eps", eps).withColumn("th", thresholds(metric, F.col("baseline_value"), F.abs(scale)))
    j = j.withColumn("wins", F.size(F.filter(F.coalesce("gains", F.array().cast("array<double>")), lambda g: g > F.col("eps"))).cast("long")).withColumn("joint_gain", improvement(F.col("primary_value"), F.col("baseline_value"), direction))
    near_zero = F.lit(metric in ("mae", "rmse")) & (F.col("baseline_value") <= F.col("eps"))
    reason = (
        F.when(F.col("candidate_id") == F.col("baseline_id"), "BASELINE")
        .when(F.col("status") != "completed", "CANDIDATE_INCOMPLETE")
        .when(~F.col("baseline_done"), "BASELINE_INCOMPLETE")
        .when(stop, "METHODOLOGY_BLOCKED")
        .when(near_zero, "BASELINE_ERROR_NEAR_ZERO")
        .when(F.col("joint_gain") + F.col("eps") < F.col("th.gain"), "GAIN_BELOW_MINIMUM")
        .when(F.coalesce("pairs", F.lit(0)) < 3, "TOO_FEW_PAIRED_UNITS")
        .when(F.col("wins") < F.ceil(F.col("pairs") * 0.6), "TOO_FEW_WINS")
        .when(F.col("median_gain") <= F.col("eps"), "MEDIAN_GAIN_NOT_POSITIVE")
    )
    return j.select(*keys, "candidate_id", "primary_value", "complexity", "status", "baseline_id", "joint_gain", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), "wins", "median_gain", F.col("th.tie").alias("tie"), F.col("th.gain").alias("minimum_gain"), "eps", reason.isNull().alias("passes"), reason.alias("reason"))


def select_candidate(judged: DataFrame, direction: str, keys: list[str] | None = None) -> DataFrame:
    """keys, selected_id, best_observed_id, baseline_id, passing: the simplest candidate within the tie band of the best passing one, or the
    baseline where none passes."""
    keys = keys or []
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    sign = 1.0 if direction == "max" else -1.0
    score = F.col("primary_value") * sign
    best = F.max(F.when(F.col("passes"), score)).over(part)
    j = judged.withColumn("score", score).withColumn("close", F.col("passes") & (score + F.col("tie") + F.col("eps") >= best))
    chosen = F.min(F.when(F.col("close"), F.struct("complexity", (-F.col("score")).alias("s"), "candidate_id")))
    top = F.min(F.when((F.col("status") == "completed") & F.col("primary_value").isNotNull(), F.struct((-F.col("score")).alias("s"), "complexity", "candidate_id")))
    out = j.groupBy(*keys).agg(chosen.alias("c"), top.alias("t"), F.max("baseline_id").alias("baseline_id"), F.count_if("passes").alias("passing"))
    return out.select(*keys, F.coalesce("c.candidate_id", "baseline_id").alias("selected_id"), F.col("t.candidate_id").alias("best_observed_id"), "baseline_id", "passing")


def confirmation_gate(units: DataFrame, joint: DataFrame, metric: str, direction: str, target_scale: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """keys, confirmed, pairs, wins, middle_gain, reason. ``units``: keys, unit_id, candidate_value, baseline_value; ``joint``: keys,
    candidate_value, baseline_value over all units. At least three pairs, two wins, a positive upper-middle gain and the least joint
    gain are needed."""
    keys = keys or []
    gain = improvement(F.col("candidate_value"), F.col("baseline_value"), direction)
    sums = units.groupBy(*keys).agg(F.count(gain).alias("pairs"), F.array_sort(F.collect_list(gain)).alias("gains"))
    j = sums.join(joint, keys) if keys else sums.join(joint, F.lit(True))
    th = thresholds(metric, F.col("baseline_value"), F.lit(abs(target_scale)))
    j = j.withColumn("th", th).withColumn("joint_gain", gain).withColumn("wins", F.size(F.filter("gains", lambda g: g > F.col("th.eps"))).cast("long")).withColumn("middle_gain", F.try_element_at("gains", F.floor(F.size("gains") / 2).cast("int") + 1))
    ok = F.coalesce((F.col("joint_gain") + F.col("th.eps") >= F.col("th.gain")) & (F.col("pairs") >= 3) & (F.col("wins") >= 2) & (F.col("middle_gain") > F.col("th.eps")), F.lit(False))
    return j.select(*keys, ok.alias("confirmed"), "pairs", "wins", "middle_gain", F.when(~ok, "GAIN_NOT_REPEATED_IN_CONFIRMATION").alias("reason"))
