"""Queries over monthly forecasting: order totals by priority, with the total as a sixth series; H = 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import forecast as fc
from tallywright.operators import temporal
from tallywright.plans.register import query, read
from tallywright.staging import materialize

H = 6
KEYS = ["series_id"]


def _rows(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return orders.select(F.explode(F.array(F.lit("total"), F.col("o_orderpriority"))).alias("series_id"), "o_orderdate", "o_totalprice")


def _series(spark, sf):
    # a row per month and series: small beside the orders, and read by every branch of the plan
    return materialize(temporal.prepare_series(_rows(spark, sf), "o_orderdate", "o_totalprice", "sum", KEYS)[0], "series")


_S = """s AS (
  SELECT series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value
  FROM (SELECT 'total' AS series_id, * FROM orders UNION ALL SELECT o_orderpriority, * FROM orders) GROUP BY 1, 2),
ok AS (SELECT series_id FROM s GROUP BY 1 HAVING count(*) = datediff('month', min(month), max(month)) + 1),
x AS (SELECT series_id, month, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS INTEGER) AS t FROM s WHERE series_id IN (SELECT series_id FROM ok)),
ln AS (SELECT series_id, count(*) AS n FROM x GROUP BY 1),
w AS (SELECT series_id, n, CASE WHEN n >= 54 THEN 36 WHEN n >= 42 THEN 24 WHEN n >= 30 THEN 12 WHEN n >= 20 THEN 2 END AS w0 FROM ln),
p AS (SELECT series_id, CAST(n AS INTEGER) AS n, coalesce(w0, 2) AS w, coalesce(n >= w0 + 24, false) AS has_holdout, CAST(CASE WHEN coalesce(n >= w0 + 24, false) THEN n - 6 ELSE n END AS INTEGER) AS d FROM w),
plan AS (SELECT *, CAST(greatest(least(6, floor((d - w) / 6.0)), 0) AS INTEGER) AS k FROM p),
o AS (
  SELECT series_id, 'selection_backtest' AS role, 'origin-' || (j + 1) AS unit_id, CAST(d - k * 6 + j * 6 AS INTEGER) AS origin FROM plan, range(6) r(j) WHERE n >= 8 AND k >= 1 AND j < k
  UNION ALL SELECT series_id, 'final_test', 'test', d FROM plan WHERE n >= 8 AND k >= 1 AND has_holdout
  UNION ALL SELECT series_id, 'forecast_future', 'future', n FROM plan WHERE n >= 8 AND k >= 1),
oh AS (SELECT o.*, CAST(h AS INTEGER) AS horizon, CAST(origin + h - 1 AS INTEGER) AS t FROM o, range(1, 7) g(h)),
st AS (SELECT o.series_id, o.origin, arg_max(value, x.t) AS last, avg(value) AS mean, regr_slope(value, x.t) AS slope, regr_intercept(value, x.t) AS icept FROM (SELECT DISTINCT series_id, origin FROM o) o JOIN x ON x.series_id = o.series_id AND x.t < o.origin GROUP BY 1, 2),
sh AS (SELECT series_id, d - k * 6 AS shortest FROM plan),
raw AS (
  SELECT oh.*, 'last_value' AS candidate_id, 0 AS complexity, 2 AS needs, last AS predicted FROM oh JOIN st USING (series_id, origin)
  UNION ALL SELECT oh.*, 'historical_mean', 1, 2, mean FROM oh JOIN st USING (series_id, origin)
  UNION ALL SELECT oh.*, 'seasonal_naive', 2, 24, x.value FROM oh JOIN x ON x.series_id = oh.series_id AND x.t = oh.origin - 12 + (oh.horizon - 1) % 12
  UNION ALL SELECT oh.*, 'linear_trend', 3, 12, icept + slope * t FROM oh JOIN st USING (series_id, origin)),
pred AS (SELECT raw.*, x.value AS actual FROM raw JOIN sh USING (series_id) LEFT JOIN x ON x.series_id = raw.series_id AND x.t = raw.t WHERE shortest >= needs),
joint AS (SELECT series_id, candidate_id, any_value(complexity) AS complexity, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse FROM pred WHERE role = 'selection_backtest' GROUP BY 1, 2),
units AS (SELECT series_id, candidate_id, unit_id, avg(abs(predicted - actual)) AS mae FROM pred WHERE role = 'selection_backtest' GROUP BY 1, 2, 3),
base AS (SELECT series_id, candidate_id AS baseline_id, mae AS bv FROM joint WHERE candidate_id IN ('last_value', 'historical_mean', 'seasonal_naive') QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mae, complexity, candidate_id) = 1),
g AS (SELECT u.series_id, u.candidate_id, count(*) AS pairs, count(*) FILTER (WHERE b.mae - u.mae > 1e-3) AS wins, median(b.mae - u.mae) AS mg FROM units u JOIN base USING (series_id) JOIN units b ON b.series_id = u.series_id AND b.unit_id = u.unit_id AND b.candidate_id = base.baseline_id GROUP BY 1, 2),
judged AS (SELECT j.*, baseline_id, bv, j.candidate_id <> baseline_id AND k >= 3 AND bv - j.mae >= 0.03 * bv AND pairs >= 3 AND wins >= ceil(0.6 * pairs) AND mg > 1e-3 AS passes FROM joint j JOIN base USING (series_id) JOIN plan USING (series_id) JOIN g ON g.series_id = j.series_id AND g.candidate_id = j.candidate_id),
best AS (SELECT series_id, min(mae) AS best FROM judged WHERE passes GROUP BY 1),
pick AS (SELECT series_id, candidate_id FROM judged JOIN best USING (series_id) WHERE passes AND mae <= best + 0.01 * bv QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY complexity, mae, candidate_id) = 1),
dec AS (SELECT j.series_id, coalesce(any_value(pick.candidate_id), any_value(j.baseline_id)) AS selected_id, arg_min(j.candidate_id, j.mae) AS best_observed_id, any_value(j.baseline_id) AS baseline_id, count(*) FILTER (WHERE passes) AS passing FROM judged j LEFT JOIN pick USING (series_id) GROUP BY 1)
"""


def _q(select: str) -> str:
    return f"WITH {_S} {select}"


def _run(spark, sf, methods=None):
    series = _series(spark, sf)
    plan, pred = fc.backtest(series, KEYS, H, methods=methods)
    return series, plan, materialize(pred, "predictions")


def _sums(name, sql):
    """Registers a query over all seven methods, and under ``<name>_sums`` the same over the four that SQL can follow."""

    def add(f):
        query(name)(lambda spark, sf: f(spark, sf, None))
        query(f"{name}_sums", sql)(lambda spark, sf: f(spark, sf, fc.SQL_METHODS))
        return f

    return add


def _decided(spark, sf, methods):
    series, plan, pred = _run(spark, sf, methods)
    return series, plan, pred, fc.select_forecast(plan, pred, series, KEYS)


def _rounded(df, places=2):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("series_prepared", _q("SELECT series_id, month, round(value, 2) AS value, t FROM x"))
def series_prepared(spark, sf):
    return _rounded(_series(spark, sf))


@query("series_problems", _q("SELECT series_id, 'MISSING_MONTHLY_PERIODS' AS code FROM (SELECT DISTINCT series_id FROM s) WHERE series_id NOT IN (SELECT series_id FROM ok)"))
def series_problems(spark, sf):
    return temporal.prepare_series(_rows(spark, sf), "o_orderdate", "o_totalprice", "sum", KEYS)[1]


@query("backtest_plan", _q("SELECT series_id, n, CAST(w AS INTEGER) AS w, has_holdout, d, k, n >= 8 AND k >= 1 AS evaluable FROM plan"))
def backtest_plan(spark, sf):
    return fc.backtest(_series(spark, sf), KEYS, H, methods=fc.SQL_METHODS)[0]


@query("backtest_prefix", _q("SELECT o.series_id, unit_id, count(*) AS rows, round(sum(value), 2) AS total FROM o JOIN x ON x.series_id = o.series_id AND x.t < o.origin WHERE role = 'selection_backtest' GROUP BY 1, 2"))
def backtest_prefix(spark, sf):
    series = _series(spark, sf)
    plan = fc.backtest(series, KEYS, H, methods=fc.SQL_METHODS)[0]
    origins = fc.plan_origins(plan, KEYS, H).where(F.col("role") == "selection_backtest")
    joined = series.join(origins, KEYS).where(F.col("t") < F.col("origin"))
    return _rounded(joined.groupBy("series_id", "unit_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")))


def _method(name: str):
    @query(f"fc_{name}", _q(f"SELECT series_id, role, unit_id, horizon, round(predicted, 2) AS predicted FROM pred WHERE candidate_id = '{name}'"))
    def forecasts(spark, sf):
        return _rounded(_run(spark, sf, (name,))[2].select("series_id", "role", "unit_id", "horizon", "predicted"))

    return forecasts


fc_last_value, fc_historical_mean, fc_seasonal_naive, fc_linear_trend = map(_method, fc.SQL_METHODS)


def _grouped(name: str):
    @query(f"fc_{name}")
    def forecasts(spark, sf):
        return _run(spark, sf, (name,))[2].select("series_id", "role", "unit_id", "horizon", "predicted")

    return forecasts


fc_ridge_month, fc_holt, fc_holt_winters = map(_grouped, ("ridge_trend_month", "holt_damped", "holt_winters_add_damped"))


@_sums("backtest_predictions", _q("SELECT series_id, role, unit_id, horizon, candidate_id, t, round(predicted, 2) AS predicted, round(actual, 2) AS actual FROM pred"))
def backtest_predictions(spark, sf, methods):
    return _rounded(_run(spark, sf, methods)[2].select("series_id", "role", "unit_id", "horizon", "candidate_id", "t", "predicted", "actual"))


@_sums("backtest_metrics", _q("SELECT series_id, candidate_id, n, round(mae, 2) AS mae, round(rmse, 2) AS rmse FROM joint"))
def backtest_metrics(spark, sf, methods):
    return _rounded(fc.backtest_metrics(_run(spark, sf, methods)[2], KEYS)[0].select("series_id", "candidate_id", "n", "mae", "rmse"))


@_sums("forecast_selection", _q("SELECT * FROM dec"))
def forecast_selection(spark, sf, methods):
    return _decided(spark, sf, methods)[3]


@_sums("forecast_future", _q("SELECT dec.series_id, selected_id, CAST(m.last + to_months(horizon) AS DATE) AS target_month, horizon, round(predicted, 2) AS predicted, predicted IS NULL AS fallback FROM dec JOIN pred ON pred.series_id = dec.series_id AND pred.candidate_id = dec.selected_id AND role = 'forecast_future' JOIN (SELECT series_id, max(month) AS last FROM x GROUP BY 1) m ON m.series_id = dec.series_id"))
def forecast_future(spark, sf, methods):
    series, _, pred, decision = _decided(spark, sf, methods)
    return _rounded(fc.forecast_future(pred, decision, series, KEYS))


@_sums("horizon_stability", _q("SELECT *, CASE WHEN count(*) FILTER (WHERE verdict = 'worse') OVER (PARTITION BY series_id) >= ceil(count(*) OVER (PARTITION BY series_id) / 3.0) THEN 'HORIZON_PERFORMANCE_VARIES' END AS warning FROM (SELECT a.series_id, a.horizon, a.n, round(a.mae, 2) AS selected_mae, round(b.mae, 2) AS baseline_mae, round((b.mae - a.mae) / nullif(b.mae, 0), 2) AS improvement, CASE WHEN (b.mae - a.mae) / nullif(b.mae, 0) > 0.1 THEN 'better' WHEN (b.mae - a.mae) / nullif(b.mae, 0) < -0.1 THEN 'worse' ELSE 'similar' END AS verdict FROM (SELECT series_id, horizon, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM pred JOIN dec USING (series_id) WHERE role = 'selection_backtest' AND candidate_id = selected_id GROUP BY 1, 2) a JOIN (SELECT series_id, horizon, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM pred JOIN dec USING (series_id) WHERE role = 'selection_backtest' AND candidate_id = baseline_id GROUP BY 1, 2) b ON a.series_id = b.series_id AND a.horizon = b.horizon)"))
def horizon_stability(spark, sf, methods):
    _, _, pred, decision = _decided(spark, sf, methods)
    return _rounded(fc.horizon_stability(pred, decision, KEYS))


@_sums("extrapolation_flags", _q("SELECT f.series_id, f.horizon, round(f.predicted, 2) AS predicted, f.predicted < a - 3 * iqr OR f.predicted > b + 3 * iqr AS extrapolates FROM pred f JOIN dec ON dec.series_id = f.series_id AND dec.selected_id = f.candidate_id JOIN (SELECT series_id, min(value) AS a, max(value) AS b, quantile_cont(value, CAST(0.75 AS DOUBLE)) - quantile_cont(value, CAST(0.25 AS DOUBLE)) AS iqr FROM x GROUP BY 1) q ON q.series_id = f.series_id WHERE role = 'forecast_future'"))
def extrapolation_flags(spark, sf, methods):
    series, _, pred, decision = _decided(spark, sf, methods)
    return _rounded(fc.extrapolation_flags(fc.forecast_future(pred, decision, series, KEYS), series, KEYS))


@_sums("prediction_roles", _q("SELECT series_id, 'history' AS role, count(*) AS rows, CAST(0 AS BIGINT) AS predicted_rows FROM x GROUP BY 1 UNION ALL SELECT pred.series_id, role, count(*), count(predicted) FROM pred JOIN dec ON dec.series_id = pred.series_id AND selected_id = candidate_id GROUP BY 1, 2"))
def prediction_roles(spark, sf, methods):
    series, _, pred, decision = _decided(spark, sf, methods)
    return fc.prediction_roles(series, pred, decision, KEYS).groupBy("series_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.count("predicted").alias("predicted_rows"))


@query("smoothing_status", _q("SELECT series_id, role, unit_id, origin, m.candidate_id, 'converged' AS status, CAST(NULL AS VARCHAR) AS reason FROM o JOIN (VALUES ('holt_damped', 12), ('holt_winters_add_damped', 36)) m(candidate_id, needs) ON origin >= needs"))
def smoothing_status(spark, sf):
    """How the parameter search of the smoothing methods ended for each series and origin."""
    series = _series(spark, sf)
    plan = fc.backtest_plan(series.groupBy(*KEYS).agg((F.max("t") + 1).alias("n")), KEYS, H)
    return fc.smoothing_status(series, fc.plan_origins(plan, KEYS, H), KEYS).drop("rounds", "final_step")
