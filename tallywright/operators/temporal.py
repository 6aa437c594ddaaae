"""Months: aggregation, calendars, gaps, and preparation of many monthly series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.dates import month_start
from tallywright.functions.numbers import as_number


def monthly(df: DataFrame, date: str, value: str, how: str, keys: list[str] | None = None) -> DataFrame:
    """keys, month, value: sum or mean of a month's values."""
    keys = keys or []
    combine = {"sum": F.sum, "mean": F.avg}[how]
    return df.groupBy(*keys, month_start(F.col(date).try_cast("date")).alias("month")).agg(combine(as_number(F.col(value))).alias("value"))


def calendar(df: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """keys, month: every month from a series' first to its last."""
    keys = keys or []
    m = month_start(F.col(date).try_cast("date"))
    return df.groupBy(*keys).agg(F.min(m).alias("a"), F.max(m).alias("b")).where(F.col("a").isNotNull()).select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def missing_months(df: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """keys, month: months of the calendar without a row."""
    keys = keys or []
    seen = df.select(*keys, month_start(F.col(date).try_cast("date")).alias("month")).distinct()
    return calendar(df, date, keys).join(seen, [*keys, "month"], "left_anti")


def month_index(series: DataFrame, keys: list[str]) -> DataFrame:
    """``series`` with t = 0, 1, ... by month within a series."""
    return series.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy("month")).cast("int") - 1)


def temporal_check(df: DataFrame, date: str, keys: list[str] | None = None) -> DataFrame:
    """Per series: first and last date, frequency label, observed and missing months, rows in repeated months, invalid dates."""
    keys = keys or []
    d = df.select(*keys, F.col(date).try_cast("date").alias("d"))
    # distinct dates are few for each series; gaps between them need one ordered pass over those only
    counted = d.groupBy(*keys, "d").count()
    days = counted.where(F.col("d").isNotNull())
    gaps = days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(*keys, F.lit(0)).orderBy("d"))))
    repeats = F.sum(F.col("count") - 1)  # rows on a date already seen: gaps of zero days
    spread = gaps.groupBy(*keys, F.col("gap").alias("gap")).agg(F.count(F.lit(1)).alias("n"), repeats.alias("zero"))
    zeros = spread.groupBy(*keys).agg(F.sum("zero").alias("n")).withColumn("gap", F.lit(0))
    weights = spread.where(F.col("gap").isNotNull()).select(*keys, "gap", "n").unionByName(zeros.select(*keys, "gap", "n")).where(F.col("n") > 0)
    median = weights.groupBy(*keys).agg(F.expr("percentile(gap, 0.5D, n)").alias("median_gap"))
    months = days.groupBy(*keys, month_start(F.col("d")).alias("month")).agg(F.sum("count").alias("rows"))
    observed = months.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed_months"), F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).cast("long").alias("rows_in_repeated_months"), F.min("month").alias("m0"), F.max("month").alias("m1"))
    basic = counted.groupBy(*keys).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("count"))), F.lit(0)).cast("long").alias("invalid_dates"))
    if keys:
        joined = basic.join(observed, keys, "left").join(median, keys, "left")
    else:  # one row each
        joined = basic.join(observed, F.lit(True), "left").join(median, F.lit(True), "left")
    label = F.when(F.col("median_gap") <= 2, "daily").when(F.col("rows_in_repeated_months") == 0, "monthly").otherwise("several_per_month")
    expected = F.round(F.months_between("m1", "m0")).cast("long") + 1
    return joined.select(*keys, "first_date", "last_date", label.alias("frequency"), F.coalesce("observed_months", F.lit(0)).cast("long").alias("observed_months"), F.coalesce(expected - F.col("observed_months"), F.lit(0)).cast("long").alias("missing_months"), F.coalesce("rows_in_repeated_months", F.lit(0)).cast("long").alias("rows_in_repeated_months"), "invalid_dates")


def prepare_series(df: DataFrame, date: str, value: str, how: str | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(series: keys, month, t, value; problems: keys, code). A series with a bad date or value, a gap, or repeated months without an
    aggregation has problem rows and no series."""
    rows = df.select(*keys, F.col(date).try_cast("date").alias("__d"), as_number(F.col(value)).alias("__v"))
    month = month_start(F.col("__d"))
    per_month = rows.groupBy(*keys, month.alias("month")).agg(F.sum("__v").alias("sum"), F.count("__v").alias("n"), F.count(F.lit(1)).alias("rows"))
    state = per_month.groupBy(*keys).agg(F.bool_or(F.col("month").isNull()).alias("bad_date"), F.bool_or(F.col("n") < F.col("rows")).alias("bad_value"), F.bool_or((F.col("rows") > 1) & F.col("month").isNotNull()).alias("repeated"), F.count("month").alias("months"), F.min("month").alias("m0"), F.max("month").alias("m1"))
    gap = F.coalesce(F.round(F.months_between("m1", "m0")).cast("long") + 1 > F.col("months"), F.lit(False))
    codes = F.filter(F.array(F.when(F.col("bad_date"), "FORECAST_INVALID_DATE"), F.when(F.col("bad_value"), "FORECAST_INVALID_VALUE"), F.when(F.col("repeated") & F.lit(how is None), "DUPLICATE_MONTHS_REQUIRE_AGGREGATION"), F.when(gap, "MISSING_MONTHLY_PERIODS")), lambda x: x.isNotNull())
    judged = state.select(*keys, codes.alias("codes"))
    problems = judged.select(*keys, F.explode("codes").alias("code"))
    good = judged.where(F.size("codes") == 0).select(*keys)
    combined = per_month.select(*keys, "month", (F.col("sum") / F.col("n") if how == "mean" else F.col("sum")).alias("value"))
    return month_index(combined.join(good, keys, "left_semi"), keys), problems
