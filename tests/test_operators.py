from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.functions.hashing import row_block
from tallywright.operators import events, forecast, metrics, models, profile, quantiles, recipe, selection, splits, summary, tables, temporal
from tallywright.sources import files
from tallywright.streaming import live


def test_recipe_and_quarantine(spark):
    rows = [(1, "15/03/2026", "1.234,56", " a "), (2, "imposible", "x", "b"), (3, "16/03/2026", "7,5", ""), (4, "16/03/2026", "7,5", "")]
    df = spark.createDataFrame(rows, "id int, day string, amount string, zone string")
    r = recipe.Recipe(
        columns=(recipe.ColumnRule("day", "date", date_order="DMY", invalid="segregate"), recipe.ColumnRule("amount", "numeric", decimal=",", thousands=".", invalid="segregate"), recipe.ColumnRule("zone", "text", trim=True, empty_to_null=True)),
        drop_duplicates=True,
    )
    done = recipe.apply_recipe(df, r, "id")
    assert {x.id: (x.day, x.amount, x.zone) for x in done.data.collect()} == {1: (dt.date(2026, 3, 15), 1234.56, "a"), 3: (dt.date(2026, 3, 16), 7.5, None)}
    assert {(x.row_id, x.reason, x.column_id, x.original_value, x.stage) for x in done.quarantine.collect()} == {(2, "UNCONVERTIBLE_VALUE", "day", "imposible", "conversion"), (4, "EXACT_DUPLICATE", None, None, "duplicates")}
    with pytest.raises(ValueError, match="UNCONVERTIBLE_VALUES"):
        recipe.apply_recipe(df, recipe.Recipe(columns=(recipe.ColumnRule("amount", "numeric", decimal=","),)), "id")
    with pytest.raises(ValueError, match="INCOMPATIBLE"):
        recipe.check_compatible(df, recipe.Recipe(expected_columns=("gone",)))
    assert r.digest() == recipe.Recipe(**r.__dict__).digest()


@pytest.mark.parametrize("bad", [{"type": "text", "date_order": "DMY"}, {"type": "date"}, {"type": "numeric", "decimal": ",", "thousands": ","}, {"type": "numeric", "merges": {"a": "b"}}, {"type": "keep", "percent": True}])
def test_incoherent_rules(bad):
    with pytest.raises(ValueError):
        recipe.ColumnRule("c", **bad)


def test_monthly(spark):
    df = spark.createDataFrame([("2026-01-01", 10.0), ("2026-01-15", 20.0), ("2026-02-01", 30.0)], "d string, v double")
    assert sorted(r.value for r in temporal.monthly(df, "d", "v", "sum").collect()) == [30, 30]
    assert sorted(r.value for r in temporal.monthly(df, "d", "v", "mean").collect()) == [15, 30]
    gap = df.where("d != '2026-01-15'").unionByName(spark.createDataFrame([("2026-05-01", 1.0)], "d string, v double"))
    assert [r.month for r in temporal.missing_months(gap, "d").orderBy("month").collect()] == [dt.date(2026, 3, 1), dt.date(2026, 4, 1)]
    assert temporal.prepare_series(gap.withColumn("k", F.lit(1)), "d", "v", "sum", ["k"])[1].first().code == "MISSING_MONTHLY_PERIODS"
    assert {r.code for r in temporal.prepare_series(df.withColumn("k", F.lit(1)), "d", "v", None, ["k"])[1].collect()} == {"DUPLICATE_MONTHS_REQUIRE_AGGREGATION"}
    assert temporal.temporal_check(gap, "d").first().missing_months == 2


def test_profile(spark):
    df = spark.createDataFrame([(20 + k, 100 + k, f"operation {k:04d}", None if k == 3 else float(k), "x") for k in range(100)], "edad int, cliente_id int, `Operación ID` string, ventas double, fixed string")
    p = {r.column_id: r for r in profile.column_profile(df).collect()}
    assert [c for c in p if p[c].possible_id] == ["cliente_id", "Operación ID"]
    assert p["ventas"].issues == ["MISSING_VALUES"] and p["fixed"].issues == ["CONSTANT_OR_EMPTY"]
    box = profile.boxplots(df.withColumn("ventas", F.col("edad") - 20.0), ["ventas"]).first()
    assert (box.median, box.q1, box.outliers) == (49.5, 24.75, 0)
    r = {(x.left, x.right): x.r for x in profile.correlations(df.withColumn("flat", F.lit(1)), ["edad", "ventas", "flat"]).collect()}
    assert r["edad", "ventas"] == pytest.approx(1) and r["edad", "flat"] is None
    with pytest.raises(ValueError, match="UNKNOWN"):
        profile.resolve_features(profile.column_profile(df), "ventas", include=["nope"])


def test_tables(spark):
    assert [r[2] for r in tables.column_mapping(["a", " a ", "", "b  c"])] == ["a", "a (2)", "Column 3", "b c"]
    df = spark.range(1000).repartition(7)
    assert sorted(r.id for r in tables.stride_sample(df, ["id"], 400).collect()) == list(range(0, 1000, 3))
    assert sorted(r.id for r in tables.even_sample(df, ["id"], 5).collect()) == [0, 249, 499, 749, 999]
    assert [r.id for r in tables.page(df, ["id"], 2, 3).collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        tables.check_width(df.select(*[F.lit(1).alias(f"c{k}") for k in range(301)]))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title\nnote\nx;y\n1;é\n2;b\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), sep=";", header_row=2)
    assert got.columns == ["x", "y"] and {tuple(r) for r in got.collect()} == {("1", "é"), ("2", "b")}
    (tmp_path / "b.txt").write_bytes("x|y\n1|é\n2|ñ\n".encode("latin-1"))
    seen = files.inspect_csv(spark, str(tmp_path / "b.txt")).first()
    assert (seen.encoding, seen.delimiter) == ("latin-1", "|")
    with pytest.raises(ValueError):
        files.read_csv(spark, "x", sep="#")


def test_metrics(spark):
    df = spark.createDataFrame([("a", 4.0, 4.0), ("a", 4.0, 5.0), ("b", 10.0, 20.0), ("b", 20.0, 10.0), ("c", 1.0, 1.0)], "k string, actual double, predicted double")
    m = {r.k: r for r in metrics.regression_metrics(df, ["k"]).collect()}
    assert m["a"].r2 is None and m["a"].r2_reason == "CONSTANT_TARGET" and m["b"].mae == 10 and m["c"].r2_reason == "INSUFFICIENT_SUPPORT"
    labels = spark.createDataFrame([("x",), ("y",), ("z",)], "label string")
    pred = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "actual string, predicted string")
    per = metrics.class_metrics(metrics.confusion_matrix(pred, labels))
    z = per.where("label = 'z'").first()
    assert (z.recall, z.precision, z.f1, z.recall_reason) == (None, None, None, "NO_ACTUAL_CASES")
    whole = metrics.classification_metrics(per).first()
    assert whole.accuracy == pytest.approx(2 / 3) and whole.balanced_accuracy is None
    flat = metrics.error_histogram(spark.createDataFrame([(1.0, 2.0)] * 4, "actual double, predicted double")).collect()
    assert [r.n for r in sorted(flat, key=lambda r: r.bin)] == [0, 4] and {r.low for r in flat} == {0.5, 1.0}


def policy(spark, candidates, units, metric="mae", direction="min", scale=10.0, blocked=False):
    c = spark.createDataFrame(candidates, "candidate_id string, primary_value double, complexity int, status string")
    u = spark.createDataFrame([(i, f"u{k}", float(v)) for i, vs in units.items() for k, v in enumerate(vs)], "candidate_id string, unit_id string, value double")
    judged = selection.judge_candidates(c, u, c.where("candidate_id = 'base'"), metric, direction, scale, blocked)
    return selection.select_candidate(judged, direction).first()


@pytest.mark.parametrize(
    ("candidates", "units", "want"),
    [
        ([("base", 10.0, 0, "completed"), ("a", 9.8, 1, "completed")], {"base": [10] * 5, "a": [9.8] * 5}, "base"),
        ([("base", 10.0, 0, "completed"), ("a", 8.0, 1, "completed")], {"base": [10] * 5, "a": [1, 11, 11, 11, 6]}, "base"),
        ([("base", 10.0, 0, "completed"), ("a", 7.05, 2, "completed"), ("b", 7.0, 5, "completed")], {"base": [10] * 5, "a": [7.05] * 5, "b": [7.0] * 5}, "a"),
        ([("base", 10.0, 0, "completed"), ("a", 1.0, 1, "failed")], {"base": [10] * 5, "a": [1] * 2}, "base"),
        ([("base", 0.0, 0, "completed"), ("a", 0.0, 1, "completed")], {"base": [0] * 5, "a": [0] * 5}, "base"),
        ([("base", 10.0, 0, "completed"), ("a", 5.0, 1, "completed")], {"base": [10] * 2, "a": [5] * 2}, "base"),
    ],
)
def test_selection_policy(spark, candidates, units, want):
    assert policy(spark, candidates, units).selected_id == want


def test_blocked_and_maximised(spark):
    good = [("base", 10.0, 0, "completed"), ("a", 5.0, 1, "completed")]
    assert policy(spark, good, {"base": [10] * 5, "a": [5] * 5}, blocked=True).selected_id == "base"
    best = [("base", 0.5, 0, "completed"), ("a", 0.9, 1, "completed")]
    assert policy(spark, best, {"base": [0.5] * 5, "a": [0.9] * 5}, "accuracy", "max", 1.0).selected_id == "a"


@pytest.mark.parametrize(("values", "ok"), [([8, 8, 11], True), ([11, 8, 11], False), ([8, None, 8], False)])
def test_confirmation(spark, values, ok):
    units = spark.createDataFrame([(f"u{k}", None if v is None else float(v), 10.0) for k, v in enumerate(values)], "unit_id string, candidate_value double, baseline_value double")
    joint = spark.createDataFrame([(9.0, 10.0)], "candidate_value double, baseline_value double")
    assert selection.confirmation_gate(units, joint, "mae", "min", 10.0).first().confirmed == ok


def test_splits(spark):
    df = spark.range(24).select(F.col("id").alias("row_id"), F.when(F.col("id") == 20, 3).when(F.col("id").isin(21, 22), 9).otherwise(F.col("id")).alias("block"), (F.col("id") % 3 == 0).cast("string").alias("y"))
    folds = splits.group_folds(df, "block", 5, 1)
    made = splits.materialize_splits(df, folds, "block", "row_id", 5)
    assert splits.leaking_blocks(made).count() == 0 and made.where("part = 'validation'").count() == 24
    assert [splits.fold_count(n, n) for n in (1, 3, 5, 9, 30)] == [0, 3, 2, 3, 5]
    base = splits.reference_predictions(df.withColumn("v", F.col("row_id").cast("double")), folds, "block", "row_id", "v", "median", 5)
    fold_of = {r.block: r.fold for r in folds.collect()}
    data = [(r.row_id, fold_of[r.block]) for r in df.collect()]
    want = {f"fold-{u}": float(np.median([i for i, f in data if f != u])) for u in range(1, 6)}
    assert {r.unit_id: r.predicted for r in base.collect()} == want
    found, k, _ = splits.feasible_stratified(df.withColumn("block", F.col("row_id")), "block", "y", 3)
    assert k == 5 and found.groupBy("fold").agg(F.count_distinct("label").alias("c")).where("c < 2").count() == 0


def series(spark, **named):
    rows = [(name, dt.date(2016 + k // 12, k % 12 + 1, 1), k, float(v)) for name, values in named.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, month date, t int, value double")


def test_forecast_winners(spark):
    t = np.arange(72)
    season = 50 * np.sin(2 * np.pi * t / 12)
    s = series(spark, constant=np.full(72, 7.0), trend=5.0 * t + 3, seasonal=100 + season, short=np.arange(7.0)).persist()
    plan, pred = forecast.backtest(s, ["series_id"], 3, methods=forecast.SQL_METHODS)
    p = {r.series_id: r for r in plan.collect()}
    assert (p["trend"].w, p["trend"].k, p["trend"].has_holdout, p["trend"].d) == (36, 6, True, 69)
    chosen = {r.series_id: r.selected_id for r in forecast.select_forecast(plan, pred, s, ["series_id"]).collect()}
    assert (chosen["constant"], chosen["trend"], chosen["seasonal"]) == ("last_value", "linear_trend", "seasonal_naive")
    future = forecast.forecast_future(pred, forecast.select_forecast(plan, pred, s, ["series_id"]), s, ["series_id"]).where("series_id = 'trend'").orderBy("horizon").collect()
    assert [r.target_month for r in future] == [dt.date(2022, m, 1) for m in (1, 2, 3)] and [r.predicted for r in future] == [pytest.approx(5 * k + 3) for k in (72, 73, 74)]


def test_grouped_methods(spark):
    t = np.arange(60)
    y = 100 + 2.0 * t + 10 * np.sin(2 * np.pi * t / 12)
    months = t % 12
    want = 100 + 2.0 * np.arange(60, 66) + 10 * np.sin(2 * np.pi * np.arange(60, 66) / 12)
    many = {m.id: m.many for m in forecast.METHODS if m.many}
    both = many["holt_winters_add_damped"]([y, y[:48]], 6)
    assert np.abs(both[0] - want).mean() < 4 and np.allclose(both[1], many["holt_winters_add_damped"]([y[:48]], 6)[0])
    assert np.abs(forecast.ridge_trend_month(y, months, 6) - want).mean() < 4
    assert np.abs(many["holt_damped"]([2.0 * t], 3)[0] - 2.0 * np.arange(60, 63)).mean() < 3
    x = np.column_stack([(t - t.mean()) / t.std(), *[(months == m).astype(float) for m in range(12)]])
    a = np.column_stack([np.ones(60), x])
    w = np.linalg.solve(a.T @ a + np.diag([0.0] + [1.0] * 13), a.T @ y)
    row = np.concatenate([[1.0, (60 - t.mean()) / t.std()], [1.0] + [0.0] * 11])
    assert forecast.ridge_trend_month(y, months, 1)[0] == pytest.approx(row @ w)


def test_ridge_is_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = x @ [3.0, -2.0] + rng.normal(size=80)
    df = spark.createDataFrame([(k, float(a), float(b), float(v)) for k, ((a, b), v) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, y double")
    spec = next(s for s in models.MODELS if s.id == "ridge")
    model = models.fit_model(spec, models.with_inputs(df, ["a", "b"], "regression", "y"), ["a", "b"], [], 1)
    got = np.array([r.prediction for r in model.transform(models.with_inputs(df, ["a", "b"], "regression", "y")).orderBy("row_id").collect()])
    z = x / x.std(0, ddof=1)
    c = z - z.mean(0)
    w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))
    assert np.allclose(got, y.mean() + c @ w, atol=1e-4)


def test_curves(spark):
    x = np.linspace(0, 1, 25)
    rows = [(n, k, float(a), float(f(a))) for n, f in {"line": lambda v: 2 * v, "flat": lambda v: 1.0, "bend": lambda v: (v - 0.5) ** 2}.items() for k, a in enumerate(x)]
    got = {r.n: (r.shape, r.direction) for r in models.curve_shape(spark.createDataFrame(rows, "n string, point int, x double, y double"), ["n"]).collect()}
    assert got == {"line": ("approximately_linear", "increasing"), "flat": ("flat", "flat"), "bend": ("nonlinear", "mixed")}


def test_preflight(spark):
    def codes(rows, schema, request):
        df = spark.createDataFrame(rows, schema)
        return {r.code for r in summary.preflight(df, profile.column_profile(df), request).collect()}

    ask = summary.Request
    assert {"CONSTANT_TARGET", "SMALL_DATASET"} <= codes([(float(k), 1.0) for k in range(5)], "x double, y double", ask("regression", "y"))
    assert "CLASS_SUPPORT_INSUFFICIENT" in codes([(k, "a") for k in range(5)] + [(9, "b")], "x int, y string", ask("classification", "y"))
    assert {"LOW_CLASS_SUPPORT"} <= codes([(k, "ab"[k % 2]) for k in range(8)], "x int, y string", ask("classification", "y"))
    assert "SINGLE_CLASS_TARGET" in codes([(k, "a") for k in range(5)], "x int, y string", ask("classification", "y"))
    assert "REGRESSION_TARGET_NOT_NUMERIC" in codes([(k, "a") for k in range(5)], "x int, y string", ask("regression", "y"))
    assert "CONTINUOUS_TARGET_FOR_CLASSIFICATION" in codes([(k, k / 7) for k in range(30)], "x int, y double", ask("classification", "y"))
    assert codes([(1, 1.0)], "x int, y double", ask("regression", "gone", goal="forecast")) == {"GOAL_PROBLEM_MISMATCH", "TARGET_NOT_FOUND"}
    assert {"INSUFFICIENT_EVALUABLE_ROWS", "NO_USABLE_FEATURES"} <= codes([(1, 1.0)], "x int, y double", ask("regression", "y"))
    assert "DEPENDENT_DUPLICATES_REQUIRE_REVIEW" in codes([(1, 2.0)] * 3, "x int, y double", ask("regression", "y"))
    monthly = [("2025-01-01", 1.0), ("2025-01-09", 2.0), ("2025-04-01", None), ("bad", 1.0)]
    assert {"FORECAST_INVALID_DATE", "FORECAST_INVALID_VALUE", "DUPLICATE_MONTHS_REQUIRE_AGGREGATION", "MISSING_MONTHLY_PERIODS", "INSUFFICIENT_HISTORY", "FORECAST_HORIZON_OUT_OF_RANGE"} <= codes(monthly, "d string, y double", ask("forecasting", "y", date="d", horizon=30))
    assert "FORECAST_DATE_NOT_FOUND" in codes(monthly, "d string, y double", ask("forecasting", "y", date="z"))
    assert "FORECAST_TARGET_NOT_NUMERIC" in codes([("2025-01-01", "x")], "d string, y string", ask("forecasting", "y", date="d"))
    assert summary.resolve_metric("classification") == "balanced_accuracy"
    with pytest.raises(ValueError):
        summary.resolve_metric("regression", "accuracy")


def test_event_fold(spark):
    rows = [(1, 1, "candidate_started", "a", None, None), (2, 1, "unit_started", "a", "u1", None), (3, 1, "unit_completed", "a", "u1", 0.5), (3, 1, "unit_completed", "a", "u1", 0.5), (4, 1, "plan_ready", None, None, None)]
    log = spark.createDataFrame(rows, "seq long, run_id long, event_type string, candidate_id string, unit_id string, value double")
    state = events.live_state(log).first()
    assert (state.status, state.active_unit, state.completed_units, state.latest_value) == ("running", None, 1, 0.5)
    assert events.unit_progress(log).first().completed_units == 1
    assert [r.seq for r in events.replay(log, 2, 2).collect()] == [3, 3]
    with pytest.raises(ValueError):
        events.replay(log, 0, 201)
    with pytest.raises(ValueError, match="NOT_ROW_WISE"):
        live.clean_stream(log, recipe.Recipe(drop_duplicates=True), "seq", "a", "b", "c")


def test_horizon_stability(spark):
    errors = {"sel": (-1.0, 4.0, 6.0), "base": (2.0, 2.0, 2.0)}
    rows = [("s", "selection_backtest", c, h + 1, 0.0, e) for c, es in errors.items() for h, e in enumerate(es)]
    pred = spark.createDataFrame(rows, "series_id string, role string, candidate_id string, horizon int, actual double, predicted double")
    decision = spark.createDataFrame([("s", "sel", "base")], "series_id string, selected_id string, baseline_id string")
    got = forecast.horizon_stability(pred, decision, ["series_id"]).orderBy("horizon").collect()
    assert [r.verdict for r in got] == ["better", "worse", "worse"] and {r.warning for r in got} == {"HORIZON_PERFORMANCE_VARIES"}


def test_exact_quantiles_equal_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = {"even": rng.normal(size=3001), "ties": rng.integers(0, 5, 2000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "few": rng.normal(size=150)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("even", None), ("none", None)], "key string, v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (10_000, 100):  # a coarse sketch: most rows lie outside the brackets
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        got = {r.key: r for r in quantiles.exact_quantiles(rows, shares).collect()}
        assert set(got) == set(data) and all(np.allclose(got[k].q, np.quantile(v, shares)) and got[k].n == len(v) for k, v in data.items())


def test_folds_are_even_parts_of_the_hash_order(spark):
    import hashlib

    blocks = [f"b{k}" for k in range(203)]
    got = {r.block: r.fold for r in splits.group_folds(spark.createDataFrame([(b,) for b in blocks * 2], "block string"), "block", 5, 7).collect()}
    order = sorted(blocks, key=lambda b: hashlib.sha256(f"7:{b}".encode()).hexdigest())
    assert [got[b] for b in order] == sorted([1] * 41 + [2] * 41 + [3] * 41 + [4] * 40 + [5] * 40)
    few = splits.group_folds(spark.createDataFrame([("x",), ("y",)], "block string"), "block", 5, 7)
    assert sorted(r.fold for r in few.collect()) == [1, 2]


def test_a_block_of_two_classes_is_dealt_once(spark):
    rows = [(k, k // 2, "ab"[k % 2]) for k in range(40)]  # every block holds both classes
    df = spark.createDataFrame(rows, "row_id long, block long, y string")
    folds, k, _ = splits.feasible_stratified(df, "block", "y", 1)
    made = splits.materialize_splits(df, folds, "block", "row_id", k)
    assert made.where("part = 'validation'").count() == 40 and splits.leaking_blocks(made).count() == 0


def test_saved_pipelines_keep_their_categories(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(k, float(k % 7), "ab"[k % 2], float(k)) for k in range(40)], "row_id long, a double, c string, y double")
    spec = next(s for s in models.MODELS if s.id == "ridge")
    inputs = models.with_inputs(df, ["a"], "regression", "y")
    model = models.fit_model(spec, inputs, ["a"], ["c"], 1)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert [r.prediction for r in again.transform(inputs).orderBy("row_id").collect()] == [r.prediction for r in model.transform(inputs).orderBy("row_id").collect()]


def test_failed_candidates_keep_a_reason(spark):
    df = spark.createDataFrame([(k, k, float(k % 5), float(k)) for k in range(60)], "row_id long, block long, a double, y double")
    ridge = next(s for s in models.MODELS if s.id == "ridge")
    bad = models.ModelSpec("bad", 9, "regression", 2, True, lambda seed, n, sd: ridge.build(seed, n, sd).setLabelCol("absent"))
    pred, _, told = models.evaluate(df, splits.group_folds(df, "block", 3, 1), "block", "row_id", "y", "regression", [bad, ridge], ["a"], [], 3)
    status = {(r.candidate_id, r.status) for r in told.collect()}
    assert status == {("bad", "failed"), ("ridge", "completed")} and told.where("status = 'failed' AND reason IS NULL").count() == 0
    assert pred.groupBy("candidate_id").count().collect()[0]["count"] == 60
    none = models.evaluate(df, splits.group_folds(df, "block", 3, 1), "block", "row_id", "y", "regression", [ridge], ["a"], [], 3, most_seconds=0.0)
    assert none[0].count() == 0 and {r.status for r in none[2].collect()} == {"timed_out"}


def test_importance_follows_the_metric(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    rows = [(k, k, float(a), float(b), float(3 * a)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, block long, a double, b double, y double")
    folds = splits.group_folds(df, "block", 2, 1)
    ridge = next(s for s in models.MODELS if s.id == "ridge")
    _, fitted, _ = models.evaluate(df, folds, "block", "row_id", "y", "regression", [ridge], ["a", "b"], [], 2)
    held = df.join(folds, "block").withColumn("unit_id", F.concat(F.lit("fold-"), F.col("fold").cast("string")))
    by_unit = {u: m for (_, u), m in fitted.items()}
    for metric in ("mae", "r2"):
        got = {r.feature: r for r in models.permutation_importance(by_unit, held, ["a", "b"], ["a", "b"], "regression", "y", metric).collect()}
        assert got["a"].importance > 0.5 and abs(got["b"].importance) < 0.1 and got["a"].n == 6
    assert models.permutation_importance(by_unit, held.limit(0), ["a"], ["a", "b"], "regression", "y").count() == 0


def test_csv_with_skipped_records_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('made by hand;x\nn;caf\u00e9\n1;"two\nlines"\n2;\u00e9t\u00e9\n'.encode("latin-1"))
    got = files.read_csv(spark, str(tmp_path), sep=";", encoding="latin-1", header_row=1)
    assert got.columns == ["n", "caf\u00e9"] and sorted(map(tuple, got.collect())) == [("1", "two\nlines"), ("2", "\u00e9t\u00e9")]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "b.csv").write_text('n,t\n1,"a\nb"\n2,"say ""no"""\n')
    assert sorted(map(tuple, files.read_csv(spark, str(plain)).collect())) == [(1, "a\nb"), (2, 'say "no"')]
    (plain / "c.csv").write_bytes("n,t\n1,\u00e9".encode("latin-1"))
    assert {r.path[-5:]: r.encoding for r in files.inspect_csv(spark, str(plain)).collect()} == {"b.csv": "utf-8", "c.csv": "latin-1"}


def test_duplicates_are_told_by_all_cells(spark):
    rows = [(1, None, "a"), (2, "a", None), (3, None, "a"), (4, "a\u001fb", "c"), (5, "a", "b\u001fc")]
    df = spark.createDataFrame(rows, "id int, x string, y string")
    kept, gone = recipe.dedupe_exact(df, "id")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4, 5] and [r.id for r in gone.collect()] == [3]
    assert profile.table_profile(df.drop("id")).first().duplicate_rows == 1
    assert df.select(row_block(F.col("x"), F.col("y")).alias("b")).distinct().count() == 4


def test_names_points_and_run_state(spark):
    mapping = spark.createDataFrame([("c0001", "Sales")], "column_id string, display_name string")
    assert {r.display_name for r in tables.with_names(spark.createDataFrame([("c0001",), ("c0009",)], "column_id string"), mapping).collect()} == {"Sales", "c0009"}
    df = spark.range(100).select("id", F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") * 2.0).alias("b"))
    points = profile.pair_points(df, spark.createDataFrame([("a", "b")], "left string, right string"), "id", 10).collect()
    assert len(points) == 10 and all(p.y == 2 * p.x for p in points)
    said = [("candidate_started", "a", None, None), ("candidate_completed", "a", 2.0, 1), ("candidate_completed", "b", 1.0, 3), ("candidate_completed", "c", 1.0, 2), ("candidate_failed", "d", None, None), ("confirmation_started", None, None, None)]
    log = spark.createDataFrame([(k, 1, kind, c, None, v, x, f"p{k}") for k, (kind, c, v, x) in enumerate(said)], "seq long, run_id long, event_type string, candidate_id string, unit_id string, value double, complexity int, payload string")
    state = events.run_state(log).first()
    assert state.ranking == ["c", "b", "a"] and state.confirming and state.confirmation == "p5" and state.decision is None
    runs = spark.createDataFrame([(1, "failed")], "run_id long, status string")
    assert {r.terminal for r in events.replay_run(log, runs, 2).collect()} == {True}


def test_class_trajectory(spark):
    rows = [("x", 1, "a", "a"), ("x", 1, "b", "a"), ("x", 2, "b", "b"), ("base", 1, "a", "a"), ("base", 2, "b", "a")]
    pred = spark.createDataFrame(rows, "candidate_id string, unit_order int, actual string, predicted string")
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    got = {(r.candidate_id, r.unit_order): r.value for r in metrics.class_trajectory(pred, ["candidate_id"], labels, "balanced_accuracy").collect()}
    assert got == {("x", 1): 0.5, ("x", 2): 0.75, ("base", 1): None, ("base", 2): 0.5}
    beside = metrics.beside_baseline(metrics.class_trajectory(pred, ["candidate_id"], labels), "candidate_id", "base")
    assert {r.unit_order: r.baseline_value for r in beside.collect()} == {1: None, 2: pytest.approx(1 / 3)}


def test_scopes_remove_what_was_written_in_them_and_in_their_thread(spark, tmp_path, monkeypatch):
    import os
    import uuid
    from concurrent.futures import ThreadPoolExecutor

    from tallywright import staging

    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}")
    with staging.scope(spark):
        with staging.scope(spark):
            kept = staging.materialize(spark.range(5), "kept", outer=True)
            staging.materialize(spark.range(5), "gone")
            with ThreadPoolExecutor(1) as pool:
                other = pool.submit(lambda: staging.materialize(spark.range(3), "other")).result()
        assert kept.count() == 5 and len(os.listdir(tmp_path)) == 2
    assert len(os.listdir(tmp_path)) == 1 and other.count() == 3
