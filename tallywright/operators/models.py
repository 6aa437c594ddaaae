"""Candidate models on Spark ML: train-only preprocessing, out-of-fold evaluation, importance, holdout tests and what-if curves.

Everything learned (medians, modes, category lists, scales, constants) is learned by the pipeline's ``fit`` on a unit's training rows.
"""

from __future__ import annotations

import json
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException, UnknownException
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexerModel, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import seed_of
from tallywright.operators.forests import CellForest
from tallywright.operators.metrics import MINIMISED, class_metrics, classification_metrics, confusion_matrix, regression_metrics, regression_sums
from tallywright.operators.quantiles import exact_quantiles
from tallywright.operators.tables import even_parts, numbered
from tallywright.staging import materialize, scope

MOST_CATEGORIES, MOST_FEATURES, RARE = 1000, 5000, "__rare__"
MOST_SOLVED = 4096  # features whose normal equations Spark solves
AT_ONCE = 5  # fits at the same time
COPIES_AT_ONCE = 2_000_000  # rows of a unit times the repeats that are dealt together, or a repeat is dealt alone


@dataclass(frozen=True)
class ModelSpec:
    id: str
    complexity: int
    problem: str
    needs_rows: int
    quick: bool
    build: Callable[[int, int, float], Estimator]  # (seed, training rows, label's sample deviation)
    scale: bool = False
    balanced: bool = False
    wide: Callable[[int, int, float], Estimator] | None = None  # the same model for more than MOST_SOLVED features


def _forest(estimator):
    """A hundred trees, twelve deep. Where it must be fitted on rows, the nodes that rows are in stay at the executors, or all trees would
    be sent out at each level, and more nodes than by default are split in one pass over the rows."""
    return CellForest(estimator.setNumTrees(100).setMaxDepth(12).setMinInstancesPerNode(2).setCacheNodeIds(True).setMaxMemoryInMB(512))


MODELS = (
    # the solvers divide the penalty by the label's deviation (the normal equations by that of a population): with this factor it is the
    # closed-form ridge with penalty 1. The normal equations take one pass over the rows instead of one for each step of a search
    ModelSpec("ridge", 1, "regression", 2, True, lambda seed, n, sd: LinearRegression(labelCol="__y", elasticNetParam=0.0, regParam=sd * math.sqrt((n - 1) / n) / n, standardization=False, solver="normal"), scale=True, wide=lambda seed, n, sd: LinearRegression(labelCol="__y", elasticNetParam=0.0, regParam=sd / n, standardization=False, solver="l-bfgs", maxIter=200, tol=1e-10)),
    ModelSpec("random_forest_regressor", 4, "regression", 20, False, lambda seed, n, sd: _forest(RandomForestRegressor(labelCol="__y", featureSubsetStrategy="all", seed=seed))),
    ModelSpec("logistic_regression", 1, "classification", 2, True, lambda seed, n, sd: LogisticRegression(labelCol="__y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False), scale=True),
    ModelSpec("logistic_regression_balanced", 2, "classification", 2, True, lambda seed, n, sd: LogisticRegression(labelCol="__y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, weightCol="__w"), scale=True, balanced=True),
    ModelSpec("random_forest_classifier", 4, "classification", 20, False, lambda seed, n, sd: _forest(RandomForestClassifier(labelCol="__y", featureSubsetStrategy="sqrt", seed=seed))),
    ModelSpec("random_forest_classifier_balanced", 5, "classification", 20, False, lambda seed, n, sd: _forest(RandomForestClassifier(labelCol="__y", featureSubsetStrategy="sqrt", weightCol="__w", seed=seed)), balanced=True),
)


class Mapped(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Categories as learned: nulls become the most frequent one, those that are rare or unknown the rare bucket, if there is one."""

    learned = Param(Params._dummy(), "learned", "by column: most frequent value, known values, whether any was rarer (as JSON)", TypeConverters.toString)

    def __init__(self, tables: dict[str, tuple[str | None, list[str], bool]] | None = None):
        super().__init__()
        self._setDefault(learned="{}")
        if tables:
            self._set(learned=json.dumps(tables))  # a parameter, so that saved pipelines keep it

    @property
    def tables(self) -> dict[str, tuple[str | None, list[str], bool]]:
        return json.loads(self.getOrDefault(self.learned))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (mode, known, rare) in self.tables.items():
            v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(mode))
            out[f"__cat_{c}"] = F.when(v.isin(known), v).otherwise(F.lit(RARE if rare else "__unknown__")) if known else F.lit(RARE)
        return df.withColumns(out)


def learn_categories(train: DataFrame, columns: list[str]) -> Mapped:
    """Per column: most frequent value, the values with two or more rows (the 1000 most frequent at most), whether any was rarer."""
    tables = {}
    for c in columns:
        counts = train.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("v")).count()
        top = counts.orderBy(F.desc("count"), "v").limit(MOST_CATEGORIES + 1).collect()  # the bound of a feature's width
        known = [r["v"] for r in top[:MOST_CATEGORIES] if r["count"] >= 2]
        tables[c] = (top[0]["v"] if top else None, known, len(known) < len(top))
    return Mapped(tables)


@dataclass(frozen=True)
class Inputs:
    """What a unit's training rows teach for all candidates: rows, the label's sample deviation, transformers up to ``__kept``, the width
    before constant features were left out, and what makes each deviation one."""

    rows: int
    deviation: float
    stages: list[Transformer]
    width: int
    factors: list[float] | None  # None: no feature is left, or the deviations are to be learned


def learn_inputs(train: DataFrame, numeric: list[str], categorical: list[str]) -> Inputs:
    """Preprocessing from one pass over the labels, one for medians, one for each category and one for deviations."""
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_samp("__y")).first()
    stages: list[Transformer] = []
    inputs = []
    mapped = learn_categories(train, categorical)
    width = sum(len(k) + 1 for _, k, _ in mapped.tables.values()) + 2 * len(numeric)
    if width > MOST_FEATURES:
        raise ValueError(f"TOO_MANY_FEATURES: {width}")
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=[f"__num_{c}" for c in numeric], outputCols=[f"__imp_{c}" for c in numeric]).fit(train))
        inputs += [f"__imp_{c}" for c in numeric] + [f"__mis_{c}" for c in numeric]
    if categorical:
        stages += [mapped, _indexer(mapped, categorical)]
        hot = OneHotEncoder(inputCols=[f"__idx_{c}" for c in categorical], outputCols=[f"__hot_{c}" for c in categorical], dropLast=True, handleInvalid="keep")
        stages.append(hot.fit(PipelineModel(stages).transform(train)))  # reads the indexer's attributes, no rows
        inputs += [f"__hot_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__raw"))
    raw = PipelineModel(stages).transform(train)
    variance = raw.select(Summarizer.variance(F.col("__raw"))).first()[0].toArray()
    kept = [k for k, v in enumerate(variance) if v > 0.0]
    if kept:
        stages.append(VectorSlicer(inputCol="__raw", outputCol="__kept", indices=kept))
    else:  # a slicer takes one feature at least
        stages.append(VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="__raw", outputCol="__kept").fit(raw))
    return Inputs(n, float(sd or 1.0), stages, width, [1.0 / math.sqrt(variance[k]) for k in kept] or None)


def _indexer(mapped: Mapped, categorical: list[str]) -> StringIndexerModel:
    """Indices of the values that ``mapped`` leaves in training rows, in the order of the alphabet; no pass over the rows is needed."""
    labels = []
    for c in categorical:
        _, known, rare = mapped.tables[c]
        labels.append(sorted({*known, *([RARE] if rare or not known else [])}, key=lambda v: v.encode("utf-16-be", "surrogatepass")))
    return StringIndexerModel.from_arrays_of_labels(labels, inputCols=[f"__cat_{c}" for c in categorical], outputCols=[f"__idx_{c}" for c in categorical], handleInvalid="keep")


def build_pipeline(spec: ModelSpec, train: DataFrame, inputs: Inputs, seed: int) -> PipelineModel:
    """Fit the model on training rows that have ``__y`` (and ``__w`` where the spec is balanced), after the unit's preprocessing."""
    stages = list(inputs.stages)
    if not spec.scale:
        stages.append(VectorAssembler(inputCols=["__kept"], outputCol="features"))
    elif inputs.factors:
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(inputs.factors), inputCol="__kept", outputCol="features"))
    else:
        stages.append(StandardScaler(inputCol="__kept", outputCol="features", withMean=False, withStd=True))
    stages.append((spec.wide if spec.wide and inputs.width > MOST_SOLVED else spec.build)(seed, inputs.rows, inputs.deviation))
    return Pipeline(stages=stages).fit(train)


def with_inputs(df: DataFrame, numeric: list[str], problem: str, target: str | None, labels: list[str] | None = None) -> DataFrame:
    """Numbers as doubles, an indicator of each missing one, and the target as ``__y`` (a class's place in ``labels``)."""
    cols = {f"__num_{c}": F.col(f"`{c}`").cast("double") for c in numeric} | {f"__mis_{c}": F.col(f"`{c}`").isNull().cast("double") for c in numeric}
    if target is not None:
        cols["__y"] = F.col(f"`{target}`").cast("double") if problem == "regression" else (F.array_position(F.array(*map(F.lit, labels)), F.col(f"`{target}`").cast("string")) - 1).cast("double")
    return df.withColumns(cols)


def class_labels(df: DataFrame, target: str) -> list[str]:
    return sorted(r[0] for r in df.where(F.col(f"`{target}`").isNotNull()).select(F.col(f"`{target}`").cast("string")).distinct().limit(1001).collect())


def fit_model(spec: ModelSpec, train: DataFrame, numeric: list[str], categorical: list[str], seed: int, labels: list[str] | None = None, inputs: Inputs | None = None) -> PipelineModel:
    """``inputs``: what ``learn_inputs`` has learned from the same rows, where that is there already."""
    inputs = inputs or learn_inputs(train, numeric, categorical)
    if spec.balanced:
        counts = {int(y): m for y, m in train.where(F.col("__y").isNotNull()).groupBy("__y").count().collect()}  # a row per class
        weights = [float(inputs.rows) / (len(labels) * counts[i]) if i in counts else 0.0 for i in range(len(labels))]
        train = train.where(F.col("__y").isNotNull()).withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__y") + 1).cast("int")))
    return build_pipeline(spec, train, inputs, seed)


def predicted(model: PipelineModel, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("predicted", F.col("prediction") if labels is None else F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int")))


class OverTime(Exception):
    pass


def _within(spark: SparkSession, seconds: float | None, work: Callable[[], PipelineModel]) -> PipelineModel:
    """What ``work`` returns. Its Spark jobs are cancelled once ``seconds`` have passed, and OverTime is raised."""
    if seconds is None:
        return work()
    sc, tag, over, ended = spark.sparkContext, f"fit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        over.set()
        sc.cancelJobsWithTag(tag)
        while not ended.wait(0.2):  # and those that start after it
            sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        model = work()
    except (PySparkException, Py4JJavaError) as e:
        if over.is_set():
            raise OverTime from e
        raise
    finally:
        ended.set()
        timer.cancel()
        sc.removeJobTag(tag)
    if over.is_set():
        raise OverTime
    return model


def evaluate(df: DataFrame, folds: DataFrame, block: str, row_id: str, target: str, problem: str, specs: list[ModelSpec], numeric: list[str], categorical: list[str], k: int, root_seed: int = 42, most_seconds: float | None = None, at_once: int = AT_ONCE, units: int | None = None) -> tuple[DataFrame, dict[tuple[str, str], PipelineModel], DataFrame]:
    """(predictions: candidate_id, unit_id, row_id, actual, predicted; fitted models; outcomes: candidate_id, unit_id, status, reason,
    seconds). A candidate that refuses a unit or takes over ``most_seconds`` there (its jobs are cancelled then) has no predictions in it,
    so it is never complete; the others go on. Who reads predictions of candidates that must be complete calls ``all_completed`` first.
    Failures that are not the candidate's (lost executors, full disks, any error of the engine that it gives no name) are raised: they are
    no outcome. A table without rows has no units.

    Only the first ``units`` units are fitted where a number is given: for uses that need no others. ``at_once`` candidates and units are fitted at the same time, in threads: a fit on few rows has tasks for a few cores only. Rows are
    written once for all, in ``even_parts``."""
    spark = df.sparkSession
    labels = class_labels(df, target) if problem == "classification" else None
    rows = with_inputs(df, numeric, problem, target, labels).join(folds.select(F.col("block").alias(block), "fold"), block)
    n = df.count()
    rows = materialize(even_parts(rows, n), "rows")
    kind = "double" if problem == "regression" else "string"

    learned: dict[int, Inputs] = {}
    turns = {u: threading.Lock() for u in range(1, k + 1)}

    def inputs_of(u: int, train: DataFrame) -> Inputs:
        """Learned by the first candidate that comes; candidates are told apart by their models only."""
        with turns[u]:
            if u not in learned:
                learned[u] = learn_inputs(train, numeric, categorical)
            return learned[u]

    def fit(job: tuple[ModelSpec, int]) -> tuple[PipelineModel | None, tuple]:
        spec, u = job
        unit = f"fold-{u}"
        train = rows.where(F.col("fold") != u)
        began = time.monotonic()
        try:
            model = _within(spark, most_seconds, lambda: fit_model(spec, train, numeric, categorical, seed_of(root_seed, spec.id, unit), labels, inputs_of(u, train)))
        except OverTime:
            return None, (spec.id, unit, "timed_out", f"over {most_seconds:g} s", time.monotonic() - began)
        except UnknownException:
            raise
        except (ValueError, PySparkException) as e:
            return None, (spec.id, unit, "failed", str(e).strip().split("\n")[0][:200], time.monotonic() - began)
        return model, (spec.id, unit, "completed", None, time.monotonic() - began)

    jobs = [(spec, u) for spec in specs for u in range(1, min(k, units or k) + 1)] if n else []
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        told = list(pool.map(inheritable_thread_target(spark)(fit), jobs))
    out, fitted = None, {}
    for (spec, u), (model, outcome) in zip(jobs, told, strict=True):
        if model is None:
            continue
        fitted[spec.id, outcome[1]] = model
        p = predicted(model, rows.where(F.col("fold") == u), labels).select(F.lit(spec.id).alias("candidate_id"), F.lit(outcome[1]).alias("unit_id"), F.col(row_id).alias("row_id"), F.col(f"`{target}`").cast(kind).alias("actual"), "predicted")
        out = p if out is None else out.unionByName(p)
    outcomes = spark.createDataFrame([o for _, o in told], "candidate_id string, unit_id string, status string, reason string, seconds double")
    if out is None:
        none = F.lit(None).cast(kind)
        out = rows.where(F.lit(False)).select(F.lit("").alias("candidate_id"), F.lit("").alias("unit_id"), F.col(row_id).alias("row_id"), none.alias("actual"), none.alias("predicted"))
    return out, fitted, outcomes


def all_completed(outcomes: DataFrame) -> None:
    """Raises where a candidate was not fitted in a unit: the predictions that are left would pass for all of them."""
    missing = outcomes.where(F.col("status") != "completed").orderBy("candidate_id", "unit_id").collect()  # a row per candidate and unit
    if missing:
        raise ValueError("NOT_COMPLETED: " + "; ".join(f"{r['candidate_id']} in {r['unit_id']}: {r['status']}, {r['reason']}" for r in missing))


def score(pred: DataFrame, problem: str, keys: list[str], labels: DataFrame | None = None) -> DataFrame:
    if problem == "regression":
        return regression_metrics(pred, keys)
    return classification_metrics(class_metrics(confusion_matrix(pred, labels, keys), keys), keys)


def permuted(rows: DataFrame, row_id: str, values: list[str], repeats: int, seed: int = 42) -> DataFrame:
    """row_id, repeat, donor_id and the donor's ``values``: in each repeat every row gets the values of one row, and every row gives its
    values once. Rows are ranked twice, by independent seeded hashes of their ids, over all rows; equal ranks are a pair. No task ranks
    all rows: positions come from ranges. ``row_id`` names each row."""
    return dealt(rows, row_id, values, range(repeats), seed)


def dealt(rows: DataFrame, row_id: str, values: list[str], repeats: Iterable[int], seed: int) -> DataFrame:
    """``permuted`` for the repeats of these numbers. Rows are ranked by 16 bytes of their hashes, which are not written."""
    again = F.explode(F.array(*[F.lit(r) for r in repeats])).alias("repeat")
    whole = lambda s: F.sha2(F.concat_ws(":", F.lit(str(s)), F.col("repeat").cast("string"), F.col(row_id).cast("string")), 256)
    order = lambda s: F.substring(F.unhex(whole(s)), 1, 16).alias("order")
    takers = numbered(rows.select(row_id, again).select(row_id, "repeat", order(seed)), ["repeat", "order", row_id], drop=["order"])
    givers = numbered(rows.select(row_id, *values, again).select(F.col(row_id), "repeat", *[F.col(f"`{v}`") for v in values], order(seed + 1)), ["repeat", "order", row_id], drop=["order"])
    return takers.select(row_id, "repeat", "position").join(givers.select(F.col(row_id).alias("donor_id"), *[F.col(f"`{v}`") for v in values], "position"), "position").drop("position")


def permutation_importance(models: dict[str, PipelineModel], rows: DataFrame, features: list[str], numeric: list[str], problem: str, target: str, metric: str | None = None, repeats: int = 3, most_folds: int = 3, seed: int = 42, labels: list[str] | None = None, least_rows: int = 10) -> DataFrame:
    """feature, importance, std, n: mean loss of the primary metric (mae, rmse or r2; accuracy, balanced_accuracy or macro_f1) when a
    feature's values trade places among the validation rows of a unit, as ``permuted`` deals them. ``rows`` carry ``unit_id``, ``row_id``
    and inputs; units of under ``least_rows`` rows are left out. A unit's features are scored in one pass over its rows, each copied once
    for every feature. Repeats of large units follow each other and leave their values only, so that what is on disk at a time is one
    repeat's."""
    metric = metric or ("mae" if problem == "regression" else "accuracy")
    out = None
    for unit in sorted(models)[:most_folds]:
        part = rows.where(F.col("unit_id") == unit)
        n = part.count()
        if n < least_rows:
            continue
        kind = "double" if problem == "regression" else "string"
        known = None if labels is None else rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")

        def valued(mixed: DataFrame) -> DataFrame:
            scored = predicted(models[unit], with_inputs(mixed, numeric, problem, target, labels), labels).select(F.col("__feature").alias("feature"), "repeat", F.col(f"`{target}`").cast(kind).alias("actual"), "predicted")
            # errors that sums express need no quantiles, for which all copies would be scored twice more
            table = regression_sums(scored, ["feature", "repeat"]) if metric in ("mae", "rmse") else score(scored, problem, ["feature", "repeat"], known)
            return table.select("feature", "repeat", F.col(metric).alias("value"))

        def of_repeats(some: range) -> DataFrame:
            with scope(rows.sparkSession):
                donors = dealt(part, "row_id", features, some, seed).withColumnsRenamed({f: f"__new_{f}" for f in features}).drop("donor_id")
                copied = part.join(donors, "row_id").withColumn("__feature", F.explode(F.array(*map(F.lit, features))))
                mixed = copied.withColumns({f: F.when(F.col("__feature") == f, F.col(f"`__new_{f}`")).otherwise(F.col(f"`{f}`")) for f in features}).drop(*[f"__new_{f}" for f in features])
                return materialize(valued(mixed), "values", outer=True)

        values = valued(part.withColumns({"repeat": F.lit(0), "__feature": F.lit("")}))
        step = max(1, min(repeats, COPIES_AT_ONCE // n))
        for r in range(0, repeats, step):
            values = values.unionByName(of_repeats(range(repeats)[r : r + step]))
        values = materialize(values, "values")
        plain = values.where(F.col("feature") == "").select(F.col("value").alias("plain"))
        worse = F.col("value") - F.col("plain") if metric in MINIMISED else F.col("plain") - F.col("value")
        row = values.where(F.col("feature") != "").join(plain, F.lit(True)).select("feature", worse.alias("drop"))  # one row
        out = row if out is None else out.unionByName(row)
    if out is None:
        return rows.sparkSession.createDataFrame([], "feature string, importance double, std double, n long")
    return out.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_samp("drop").alias("std"), F.count(F.lit(1)).alias("n"))


def final_test(development: DataFrame, reserved: DataFrame, spec: ModelSpec, target: str, problem: str, numeric: list[str], categorical: list[str], seed: int = 42) -> DataFrame:
    """candidate_id, actual, predicted for the selected model and the featureless reference, fitted on development rows only. A fit reads
    those several times: hand in tables rather than joins still to be made."""
    labels = class_labels(development, target) if problem == "classification" else None
    train, test = (with_inputs(d, numeric, problem, target, labels) for d in (development, reserved))
    model = fit_model(spec, train, numeric, categorical, seed_of(seed, spec.id, "final"), labels)
    kind = "double" if problem == "regression" else "string"
    mine = predicted(model, test, labels).select(F.lit(spec.id).alias("candidate_id"), F.col(f"`{target}`").cast(kind).alias("actual"), "predicted")
    level = exact_quantiles(development.select(F.lit(0).alias("key"), F.col(f"`{target}`").cast("double").alias("v")), [0.5]).select(F.col("q")[0].alias("predicted")) if problem == "regression" else development.groupBy(F.col(f"`{target}`").cast("string").alias("predicted")).count().orderBy(F.desc("count"), "predicted").limit(1).select("predicted")
    reference = test.select(F.lit("reference").alias("candidate_id"), F.col(f"`{target}`").cast(kind).alias("actual")).join(level, F.lit(True))  # one row
    return mine.unionByName(reference)


def improvement_repeated(pred: DataFrame, candidate_id: str, problem: str, metric: str, selection_gain: float, labels: DataFrame | None = None) -> DataFrame:
    """metric, value, reference_value, gain, selection_improvement_repeated: whether the selected model is better than the reference on
    reserved rows too, given that it was in selection (null where either is undefined)."""
    table = score(pred, problem, ["candidate_id"], labels).select("candidate_id", F.col(metric).alias("value"))
    mine = table.where(F.col("candidate_id") == candidate_id).select("value")
    reference = table.where(F.col("candidate_id") == "reference").select(F.col("value").alias("reference_value"))
    gain = F.col("reference_value") - F.col("value") if metric in MINIMISED else F.col("value") - F.col("reference_value")
    both = mine.join(reference, F.lit(True))  # one row each
    return both.select(F.lit(metric).alias("metric"), "value", "reference_value", gain.alias("gain"), (F.lit(selection_gain > 0) & (gain > 0)).alias("selection_improvement_repeated"))


def scenario_grid(requests: DataFrame, controls: DataFrame, driver: str, points: int = 25) -> DataFrame:
    """scenario_id, point, x: evenly spaced values of a numeric driver between its limits, for each scenario. Requests are spread by the
    points they become, so that no task makes more of them as requests get more."""
    limits = controls.where(F.col("column_id") == driver).select("low", "high")
    grid = even_parts(requests, requests.count() * points).join(F.broadcast(limits), F.lit(True)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1)).drop("low", "high")


def validate_scenarios(requests: DataFrame, controls: DataFrame) -> DataFrame:
    """requests (scenario_id, column_id, value text) with a reason where a value is unknown, not a number, out of range or no option.
    Controls, a row per column and option, are written once and sent to all tasks: requests name few columns, so they are not gathered."""
    controls = materialize(controls, "controls")
    numeric = controls.where(F.col("kind") == "numeric").select("column_id", "low", "high", F.lit("numeric").alias("kind"))
    options = controls.where(F.col("kind") == "category").select("column_id", F.col("option").alias("value"), F.lit(True).alias("listed"))
    known = controls.select("column_id", "kind").distinct()
    j = requests.join(F.broadcast(known), "column_id", "left").join(F.broadcast(numeric.drop("kind")), "column_id", "left").join(F.broadcast(options), ["column_id", "value"], "left")
    v = F.col("value").try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    reason = F.when(F.col("kind").isNull(), "UNKNOWN_COLUMN").when((F.col("kind") == "numeric") & bad, "NOT_A_NUMBER").when((F.col("kind") == "numeric") & ((v < F.col("low")) | (v > F.col("high"))), "OUT_OF_RANGE").when((F.col("kind") == "category") & F.col("listed").isNull(), "NOT_AN_OPTION")
    return j.select("scenario_id", "column_id", "value", reason.alias("reason"))


def scenario_curve(model: PipelineModel, grid: DataFrame, defaults: dict[str, object], driver: str, numeric: list[str], problem: str, labels: list[str] | None = None, label: str | None = None) -> DataFrame:
    """scenario_id, point, x, y: the prediction, or the probability of ``label``, with other inputs at their defaults unless the grid has
    them. All scenarios are scored at once."""
    rows = grid.withColumn(driver, F.col("x"))
    for c, v in defaults.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(v))
    out = model.transform(with_inputs(rows, numeric, problem, None))
    y = F.col("prediction") if label is None else vector_to_array("probability")[labels.index(label)]
    return out.select("scenario_id", "point", "x", y.alias("y"))


def curve_shape(curve: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape, direction: flat within tolerance, else approximately linear by R² ≥ 0.999, else nonlinear; and which way it goes."""
    w = Window.partitionBy(*keys).orderBy("point")
    d = curve.withColumn("d", F.col("y") - F.lag("y").over(w))
    tol = F.greatest(F.lit(1e-9), F.max(F.abs("y")) * 1e-9)
    s = d.groupBy(*keys).agg(F.max("y").alias("hi"), F.min("y").alias("lo"), tol.alias("tol"), F.regr_r2("y", "x").alias("r2"), F.max("d").alias("up"), F.min("d").alias("down"))
    flat = F.col("hi") - F.col("lo") <= F.col("tol")
    up, down = F.col("up") > F.col("tol"), F.col("down") < -F.col("tol")
    shape = F.when(flat, "flat").when(F.col("r2") >= 0.999, "approximately_linear").otherwise("nonlinear")
    return s.select(*keys, shape.alias("shape"), F.when(up & down, "mixed").when(up, "increasing").when(down, "decreasing").otherwise("flat").alias("direction"))
