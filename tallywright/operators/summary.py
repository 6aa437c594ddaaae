"""Preflight checks of a request, and the summary of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import row_mark
from tallywright.operators.profile import usable_features
from tallywright.operators.temporal import missing_months

# fixed values: metrics of each task, the default first
METRICS = {"regression": ("mae", "rmse", "r2"), "classification": ("balanced_accuracy", "accuracy", "macro_f1"), "forecasting": ("mae", "rmse")}
GOALS = {"predict_number": "regression", "predict_category": "classification", "forecast": "forecasting"}


def resolve_metric(problem: str, metric: str | None = None) -> str:
    allowed = METRICS[problem]
    if metric is not None and metric not in allowed:
        raise ValueError(f"METRIC_NOT_AVAILABLE: {metric} for {problem}")
    return metric or allowed[0]


@dataclass(frozen=True)
class Request:
    problem: str
    target: str
    goal: str | None = None
    date: str | None = None
    horizon: int = 6
    aggregation: str | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()


def _found(df: DataFrame, checks: list[tuple[str, str, object]]) -> DataFrame:
    """code, severity for each condition that holds in a one-row table."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in checks]))
    return df.select(F.explode(marks).alias("c")).select("c.*")


def preflight(df: DataFrame, profile: DataFrame, request: Request) -> DataFrame:
    """code, severity (blocker or warning), one row per finding, from one aggregate pass and the column profile."""
    spark = df.sparkSession
    static = []
    if request.goal is not None and GOALS.get(request.goal) != request.problem:
        static.append(("GOAL_PROBLEM_MISMATCH", "blocker"))
    if request.target not in df.columns:
        static.append(("TARGET_NOT_FOUND", "blocker"))
    if request.problem == "forecasting" and request.date not in df.columns:
        static.append(("FORECAST_DATE_NOT_FOUND", "blocker"))
    if request.problem == "forecasting" and not 1 <= request.horizon <= 24:
        static.append(("FORECAST_HORIZON_OUT_OF_RANGE", "blocker"))
    out = spark.range(len(static)).select(F.element_at(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity")) for c, s in static]), (F.col("id") + 1).cast("int")).alias("c")).select("c.*") if static else spark.createDataFrame([], "code string, severity string")
    if any(c in ("TARGET_NOT_FOUND", "FORECAST_DATE_NOT_FOUND") for c, _ in static):
        return out
    y = F.col(f"`{request.target}`")
    number = y.try_cast("double")
    if request.problem == "forecasting":
        d = F.col(f"`{request.date}`").try_cast("date")
        months = df.select(F.trunc(d, "MM").alias("m"), y.isNotNull().alias("has"), number.isNull().alias("bad"), d.isNull().alias("bad_date"))
        sums = months.agg(F.count_if("bad_date").alias("bad_dates"), F.count_if("bad").alias("bad_values"), F.count_if("has").alias("present"), F.count_if(F.col("has") & F.col("bad")).alias("not_number"), F.count_distinct("m").alias("months"), F.count("m").alias("rows"))
        gaps = missing_months(df, request.date).agg(F.count(F.lit(1)).alias("gaps"))
        checks = [
            ("FORECAST_TARGET_NOT_NUMERIC", "blocker", (F.col("present") > 0) & (F.col("not_number") == F.col("present"))),
            ("FORECAST_INVALID_DATE", "blocker", F.col("bad_dates") > 0),
            ("FORECAST_INVALID_VALUE", "blocker", F.col("bad_values") > 0),
            ("DUPLICATE_MONTHS_REQUIRE_AGGREGATION", "blocker", (F.col("rows") > F.col("months")) & F.lit(request.aggregation is None)),
            ("MISSING_MONTHLY_PERIODS", "blocker", F.col("gaps") > 0),
            ("INSUFFICIENT_HISTORY", "blocker", F.col("months") < request.horizon + 2),
        ]
        return out.unionByName(_found(sums.join(gaps, F.lit(True)), checks))
    usable = usable_features(profile, request.target, list(request.include) if request.include is not None else None, list(request.exclude)).agg(F.count(F.lit(1)).alias("features"))
    groups = df.select(row_mark(*[F.col(f"`{c}`") for c in df.columns]).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("c"))
    copies = groups.agg(F.coalesce(F.max("c"), F.lit(0)).alias("copies"))
    ok = number.isNotNull() if request.problem == "regression" else y.isNotNull()
    sums = df.agg(F.count_if(ok).alias("rows"), F.count_if(y.isNotNull()).alias("present"), F.count_if(number.isNotNull()).alias("numbers"), F.count_distinct(y).alias("values"))
    classes = df.where(y.isNotNull()).groupBy(y.alias("v")).count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("least"))
    kind = dict(df.dtypes)[request.target]
    row = sums.join(usable, F.lit(True)).join(copies, F.lit(True)).join(classes, F.lit(True))  # one row each
    is_class = F.lit(request.problem == "classification")
    checks = [
        ("INSUFFICIENT_EVALUABLE_ROWS", "blocker", F.col("rows") < 2),
        ("REGRESSION_TARGET_NOT_NUMERIC", "blocker", ~is_class & (F.col("present") > 0) & (F.col("numbers") == 0)),
        ("CONSTANT_TARGET", "blocker", ~is_class & (F.col("values") == 1)),
        ("CONTINUOUS_TARGET_FOR_CLASSIFICATION", "blocker", is_class & F.lit(kind in ("double", "float")) & (F.col("values") > 20)),
        ("SINGLE_CLASS_TARGET", "blocker", is_class & (F.col("values") == 1)),
        ("CLASS_SUPPORT_INSUFFICIENT", "blocker", is_class & (F.col("values") > 1) & (F.col("least") < 2)),
        ("LOW_CLASS_SUPPORT", "warning", is_class & (F.col("least") >= 2) & (F.col("least") < 5)),
        ("NO_USABLE_FEATURES", "warning", F.col("features") == 0),
        ("SMALL_DATASET", "warning", F.col("rows") < 20),
        ("DEPENDENT_DUPLICATES_REQUIRE_REVIEW", "warning", F.col("copies") > 1),
    ]
    return out.unionByName(_found(row, checks))


def run_summary(decision: DataFrame, confirmation: DataFrame | None, holdout: DataFrame | None, per_class: DataFrame | None = None) -> DataFrame:
    """One row: selected and baseline ids, evidence mode, utility, reliability level (medium with a holdout, else low), and the warning of
    a class with five or more cases that is never recalled."""
    row = decision.select("selected_id", "baseline_id")
    row = row.join(confirmation.select(F.col("confirmed").alias("confirmed")), F.lit(True)) if confirmation is not None else row.withColumn("confirmed", F.lit(None).cast("boolean"))
    row = row.join(holdout.select(F.col("used").alias("tested")), F.lit(True)) if holdout is not None else row.withColumn("tested", F.lit(False))
    zero = per_class.agg(F.bool_or((F.col("support") >= 5) & (F.col("recall") == 0)).alias("zero")) if per_class is not None else None
    row = row.join(zero, F.lit(True)) if zero is not None else row.withColumn("zero", F.lit(False))
    chosen = F.when(F.coalesce("confirmed", F.lit(True)), F.col("selected_id")).otherwise(F.col("baseline_id"))
    evidence = F.concat(F.lit("selection"), F.when(F.col("confirmed").isNotNull(), "+confirmation").otherwise(""), F.when(F.col("tested"), "+reserved_test").otherwise(""), F.when(F.col("confirmed").isNull() & ~F.col("tested"), "_only").otherwise(""))
    return row.select(chosen.alias("selected_id"), "baseline_id", evidence.alias("evidence"), F.when(chosen == F.col("baseline_id"), "reference_preferred").otherwise("improves_on_reference").alias("utility"), F.when(F.col("tested"), "medium").otherwise("low").alias("reliability"), F.when(F.col("zero"), "ZERO_RECALL_CLASS").alias("warning"))
