"""Metrics of predictions, by any grouping keys. Undefined values are null, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.quantiles import exact_quantiles, finite

MINIMISED = ("mae", "rmse", "median_ae", "p90_ae", "wape")


def regression_sums(pred: DataFrame, keys: list[str] | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """keys, n, mae, rmse and the sums the other metrics need, over rows that have an actual and a finite prediction."""
    a, e = F.col(actual), finite(F.col(predicted)) - finite(F.col(actual))
    a = F.when(e.isNotNull(), a)
    sums = [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(a) * F.count(a)).alias("sst"), F.min(a).alias("lo"), F.max(a).alias("hi"), F.sum(F.abs(e)).alias("abs_e"), F.sum(F.abs(a)).alias("abs_a")]
    return pred.groupBy(*(keys or [])).agg(*sums)


def regression_metrics(pred: DataFrame, keys: list[str] | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """keys, n, mae, rmse, median_ae, p90_ae, r2, r2_reason, wape; a row without a finite prediction counts for none of them."""
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    errors = pred.select(key.alias("key"), F.abs(finite(F.col(predicted)) - finite(F.col(actual))).alias("v"))
    quantiles = exact_quantiles(errors, [0.5, 0.9]).select(F.col("key").alias("__key"), F.col("q")[0].alias("median_ae"), F.col("q")[1].alias("p90_ae"))
    out = regression_sums(pred, keys, actual, predicted)
    out = out.join(quantiles, (F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)).eqNullSafe(F.col("__key")), "left")
    reason = F.when(F.col("n") < 2, "INSUFFICIENT_SUPPORT").when(F.col("lo") == F.col("hi"), "CONSTANT_TARGET")
    return out.select(*(keys or []), "n", "mae", "rmse", "median_ae", "p90_ae", F.when(reason.isNull(), 1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"), reason.alias("r2_reason"), (F.col("abs_e") / F.nullif(F.col("abs_a"), F.lit(0.0))).alias("wape"))


def confusion_matrix(pred: DataFrame, labels: DataFrame, keys: list[str] | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """keys, actual, predicted, n over all pairs of ``labels`` (one column, label), zeros included."""
    keys = keys or []
    counts = pred.groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    universe = labels.select(F.col("label").alias("actual")).join(labels.select(F.col("label").alias("predicted")), F.lit(True))  # classes x classes
    if keys:
        universe = counts.select(*keys).distinct().join(universe, F.lit(True))
    return universe.join(counts, [*keys, "actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def class_metrics(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, label, support, predicted_count, tp, recall, precision, f1 and the reasons of nulls, from a confusion matrix."""
    keys = keys or []
    both = matrix.select(*keys, F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("x"), "actual", "predicted", "n").select(*keys, "x.label", "x.side", "actual", "predicted", "n")
    per = both.groupBy(*keys, "label").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted_count"), F.sum(F.when((F.col("side") == "a") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"))
    s, p, t = F.col("support"), F.col("predicted_count"), F.col("tp")
    return per.select(*keys, "label", "support", "predicted_count", "tp", F.try_divide(t.cast("double"), s).alias("recall"), F.try_divide(t.cast("double"), p).alias("precision"), F.try_divide(2.0 * t, s + p).alias("f1"), F.when(s == 0, "NO_ACTUAL_CASES").alias("recall_reason"), F.when(p == 0, "NO_PREDICTED_CASES").alias("precision_reason"))


def classification_metrics(per_class: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, accuracy, balanced_accuracy (null if a class has no case), macro_f1 (null if a class's is undefined)."""
    n = F.sum("support")
    return per_class.groupBy(*(keys or [])).agg(n.alias("n"), F.try_divide(F.sum("tp").cast("double"), n).alias("accuracy"), F.when(F.bool_and(F.col("recall").isNotNull()), F.avg("recall")).alias("balanced_accuracy"), F.when(F.bool_and(F.col("f1").isNotNull()), F.avg("f1")).alias("macro_f1"))


def metric_unit(metric: Column) -> Column:
    return F.when(metric.isin("mae", "rmse", "median_ae", "p90_ae"), "target").when(metric.isin("r2", "accuracy", "balanced_accuracy", "macro_f1", "wape"), "ratio").otherwise("count")


def metric_rows(wide: DataFrame, metrics: list[str], keys: list[str], role: str, reasons: dict[str, str] | None = None) -> DataFrame:
    """Long form: keys, metric, value, unit, role, n, reason."""
    reasons = reasons or {}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(reasons[m]) if m in reasons else F.lit(None).cast("string")).alias("reason")) for m in metrics])
    return wide.select(*keys, "n", F.explode(rows).alias("m")).select(*keys, "m.metric", "m.value", metric_unit(F.col("m.metric")).alias("unit"), F.lit(role).alias("role"), "n", "m.reason")


def distribution(unit_metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, units, mean, median, std (null for one unit), spread."""
    v = F.col(value)
    return unit_metrics.groupBy(*keys).agg(F.count(v).alias("units"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), (F.max(v) - F.min(v)).alias("spread"))


def error_histogram(pred: DataFrame, actual: str = "actual", predicted: str = "predicted", most: int = 40) -> DataFrame:
    """bin, low, high, n: min(40, ceil(sqrt n)) equal bins from the least to the largest error, the last closed."""
    e = pred.select((F.col(predicted) - F.col(actual)).cast("double").alias("e")).where(F.col("e").isNotNull())
    s = e.agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where(F.col("n") > 0)
    flat = F.col("a") == F.col("b")
    s = s.select(F.least(F.lit(most), F.ceil(F.sqrt("n"))).cast("int").alias("bins"), F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    counts = e.join(F.broadcast(s), F.lit(True)).groupBy(F.least(F.expr("width_bucket(e, lo, hi, bins)"), F.col("bins")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    grid = s.withColumn("bin", F.explode(F.sequence(F.lit(1), F.col("bins"))))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def error_by_horizon(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(keys or []), "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))


def class_support(df: DataFrame, target: str) -> DataFrame:
    """label, n, smallest (the least class's n)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.min("n").alias("smallest")), F.lit(True))


def metric_trajectory(pred: DataFrame, keys: list[str], metric: str = "mae", most_units: int = 50) -> DataFrame:
    """keys, unit_order, n, value: the metric over all predictions of units 1..j, from running sums. ``pred`` has unit_order."""
    e = F.col("predicted") - F.col("actual") if metric in ("mae", "rmse", "r2") else None
    if metric == "accuracy":
        sums = {"n": F.count(F.lit(1)), "hit": F.sum((F.col("actual") == F.col("predicted")).cast("long"))}
    else:
        sums = {"n": F.count(F.lit(1)), "ae": F.sum(F.abs(e)), "se": F.sum(e * e), "y": F.sum("actual"), "yy": F.sum(F.col("actual") * F.col("actual"))}
    per_unit = pred.where(F.col("unit_order") <= most_units).groupBy(*keys, "unit_order").agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*keys).orderBy("unit_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {k: F.sum(k).over(w) for k in sums}
    value = {
        "mae": lambda: run["ae"] / run["n"],
        "rmse": lambda: F.sqrt(run["se"] / run["n"]),
        "accuracy": lambda: run["hit"].cast("double") / run["n"],
        "r2": lambda: 1 - run["se"] / F.nullif(run["yy"] - run["y"] * run["y"] / run["n"], F.lit(0.0)),
    }[metric]()
    return per_unit.select(*keys, "unit_order", run["n"].alias("n"), value.alias("value"))


def class_trajectory(pred: DataFrame, keys: list[str], labels: DataFrame, metric: str = "macro_f1", most_units: int = 50) -> DataFrame:
    """As ``metric_trajectory`` for accuracy, balanced accuracy and macro-F1 over ``labels`` (one column, label): running sums of each
    class's cases, predictions and hits. A value is null while a class's is undefined."""
    part = pred.where(F.col("unit_order") <= most_units)
    hit = (F.col("actual") == F.col("predicted")).cast("long")
    sides = F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("case"), F.lit(0).alias("guess"), hit.alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("case"), F.lit(1).alias("guess"), F.lit(0).cast("long").alias("hit"))))
    per = part.select(*keys, "unit_order", sides.alias("s")).groupBy(*keys, "unit_order", "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("case", "guess", "hit")])
    grid = part.select(*keys, "unit_order").distinct().join(labels.select("label"), F.lit(True))  # units x classes
    w = Window.partitionBy(*keys, "label").orderBy("unit_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = grid.join(per, [*keys, "unit_order", "label"], "left").select(*keys, "unit_order", "label", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("case", "guess", "hit")])
    recall = F.try_divide(F.col("hit").cast("double"), F.col("case"))
    f1 = F.try_divide(2.0 * F.col("hit"), F.col("case") + F.col("guess"))
    n = F.sum("case")
    value = {"accuracy": F.try_divide(F.sum("hit").cast("double"), n), "balanced_accuracy": F.when(F.bool_and(recall.isNotNull()), F.avg(recall)), "macro_f1": F.when(F.bool_and(f1.isNotNull()), F.avg(f1))}[metric]
    return sums.groupBy(*keys, "unit_order").agg(n.alias("n"), value.alias("value"))


def beside_baseline(trajectory: DataFrame, candidate_key: str, baseline: str, keys: list[str] | None = None) -> DataFrame:
    """A trajectory with ``baseline_value``: the reference's value up to the same unit; units it lacks are left out."""
    keys = keys or []
    base = trajectory.where(F.col(candidate_key) == baseline).select(*keys, "unit_order", F.col("value").alias("baseline_value"))
    return trajectory.where(F.col(candidate_key) != baseline).join(base, [*keys, "unit_order"])
