"""Monthly forecasting for many series: backtest plans, methods, evaluation, selection, reserved tests and future months.

A series is a set of key columns; tables are long (keys, t, month, value). Methods that sums can express run as running sums over t, read
at each origin: no history is joined to its origins. The others run as grouped-map functions, one series at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.metrics import regression_sums
from tallywright.operators.selection import judge_candidates, select_candidate


@dataclass(frozen=True)
class ForecastMethod:
    id: str
    complexity: int
    needs: int
    quick: bool
    reference: bool
    fit_predict: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None  # (values, month numbers 0-11, steps)
    many: Callable[[list[np.ndarray], int], list[np.ndarray]] | None = None  # (values of several histories, steps)

    @property
    def by_sums(self) -> bool:
        return self.fit_predict is None and self.many is None


def ridge_trend_month(values: np.ndarray, months: np.ndarray, steps: int) -> np.ndarray:
    """Ridge (penalty 1, free intercept) on standardised time and twelve month indicators."""
    n = len(values)
    t = np.arange(n + steps, dtype=float)
    scale = t[:n].std() or 1.0
    month = (months[0] + np.arange(n + steps)) % 12
    x = np.column_stack([(t - t[:n].mean()) / scale, *[(month == m).astype(float) for m in range(12)]])
    centre, level = x[:n].mean(0), values.mean()
    a = x[:n] - centre
    w = np.linalg.solve(a.T @ a + np.eye(13), a.T @ (values - level))
    return level + (x[n:] - centre) @ w


def _paths(values: np.ndarray, lengths: np.ndarray, steps: int, season: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped additive smoothing of many series at once: values[time, path], of which the first ``lengths`` count. ``p`` has a row of
    parameters for each path: alpha, beta, phi[, gamma], initial level, trend[, seasonal states]. Returns (sums of squared one-step errors,
    forecasts[path, step])."""
    alpha, beta, phi = p[:, 0], p[:, 1], p[:, 2]
    k = 4 if season else 3
    gamma = p[:, 3] * (1 - alpha) if season else None
    level, trend, seas = p[:, k], p[:, k + 1], p[:, k + 2 :].copy()
    gain, sse = alpha * beta, np.zeros(len(p))
    paths = np.arange(len(p))
    out = np.zeros((len(p), steps))
    damp = np.cumsum(phi[:, None] ** np.arange(1, steps + 1), axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(len(values)):
            slope = phi * trend
            guess = level + slope
            e = values[t] - guess
            if season:
                e = e - seas[:, t % season]
            live = t < lengths
            if not live.all():
                e = np.where(live, e, 0.0)
                level, trend = np.where(live, guess + alpha * e, level), np.where(live, slope + gain * e, trend)
            else:
                level, trend = guess + alpha * e, slope + gain * e
            sse += e * e
            if season:
                seas[:, t % season] += gamma * e
        out = level[:, None] + damp * trend[:, None]
        if season and steps:
            out += seas[paths[:, None], (lengths[:, None] + np.arange(steps)) % season]
    return sse, out


# a search has converged once no step of FINAL_STEP in any parameter helps: lowers the error by one part in 1 / LEAST_GAIN
FINAL_STEP, LEAST_GAIN, MOST_ROUNDS = 1e-4, 1e-5, 3000


@dataclass(frozen=True)
class Smoothed:
    """Of one history: forecasts, the least squared error of one step (of values in units of their deviation), the parameters it is
    reached with, and the last step size and rounds of the search."""

    forecast: np.ndarray
    error: float
    parameters: np.ndarray
    step: float
    rounds: int

    @property
    def reason(self) -> str | None:
        return "NOT_FINITE" if not np.isfinite(self.error) else "NOT_CONVERGED" if self.step >= FINAL_STEP else None


def fit_smoothing(histories: list[np.ndarray], steps: int, season: int, most: int = MOST_ROUNDS) -> list[Smoothed]:
    """For each history the forecasts under the parameters of least squared one-step error, found by pattern search within bounds (phi
    in 0.80 to 0.98) from three starts; all histories, starts and moves are evaluated together."""
    free = 4 if season else 3
    low = np.array([0.01, 0.0, 0.80] + [0.0] * (free == 4))
    high = np.array([0.99, 0.99, 0.98] + [0.99] * (free == 4))
    scaled, starts = [], []
    for values in histories:
        y = (values - values.mean()) / (float(values.std()) or 1.0)
        slope = float(np.polyfit(np.arange(len(y)), y, 1)[0])
        states = [float(np.mean(y[:season])) - slope * season / 2, slope, *[float(np.mean(y[m::season])) for m in range(season)]] if season else [float(y[0]) - slope, slope]
        scaled.append(y)
        starts.append([[*first[:free], *states] for first in ([0.3, 0.1, 0.9, 0.1], [0.7, 0.05, 0.97, 0.2], [0.1, 0.3, 0.85, 0.05])])
    p = np.array(starts).reshape(-1, len(starts[0][0]))
    of, n = np.repeat(np.arange(len(histories)), 3), p.shape[1]
    lengths = np.array([len(y) for y in scaled])
    grid = np.zeros((lengths.max(), len(histories)))
    for k, y in enumerate(scaled):
        grid[: len(y), k] = y
    step = np.tile(np.concatenate([(high - low) / 4, np.full(n - free, 0.3)]), (len(p), 1))
    value = _paths(grid[:, of], lengths[of], 0, season, p)[0]
    rounds, moved = np.zeros(len(p), int), np.zeros_like(p)
    for _ in range(most):
        open_ = np.flatnonzero(step.max(1) >= FINAL_STEP)
        if not len(open_):
            break
        rounds[open_] += 1
        moves = p[open_, None, :] + np.concatenate([np.eye(n), -np.eye(n)])[None] * step[open_, None, :]
        moves[..., :free] = np.clip(moves[..., :free], low, high)
        own = of[open_]
        tried = _paths(grid[:, np.repeat(own, 2 * n)], np.repeat(lengths[own], 2 * n), 0, season, moves.reshape(-1, n))[0].reshape(len(open_), 2 * n)
        tried = np.where(np.isfinite(tried), tried, np.inf)
        enough = value[open_] * (1 - LEAST_GAIN) - 1e-12
        better = tried < enough[:, None]
        up = better[:, :n] & (tried[:, :n] <= tried[:, n:])
        down = better[:, n:] & ~up
        together = p[open_] + (up.astype(float) - down) * step[open_]  # all moves that help, at once
        together[:, :free] = np.clip(together[:, :free], low, high)
        joint = _paths(grid[:, own], lengths[own], 0, season, together)[0]
        joint = np.where(np.isfinite(joint), joint, np.inf)
        leap = p[open_] + 2 * moved[open_]  # twice the last move again: along a valley steps grow
        leap[:, :free] = np.clip(leap[:, :free], low, high)
        far = _paths(grid[:, own], lengths[own], 0, season, leap)[0]
        far = np.where(np.isfinite(far) & moved[open_].any(1), far, np.inf)
        best = tried.argmin(1)
        places = np.stack([moves[np.arange(len(open_)), best], together, leap], 1)
        reached = np.stack([tried[np.arange(len(open_)), best], joint, far], 1)
        which = reached.argmin(1)
        for r, k in enumerate(open_):
            if reached[r, which[r]] < enough[r]:
                moved[k] = places[r, which[r]] - p[k]
                p[k], value[k] = places[r, which[r]], reached[r, which[r]]
            else:
                moved[k] = 0
                step[k] /= 2
    out = []
    for h, values in enumerate(histories):
        rows = np.flatnonzero(of == h)
        k = rows[np.argmin(np.where(np.isfinite(value[rows]), value[rows], np.inf))]
        guess = _paths(grid[:, [h]], lengths[[h]], steps, season, p[[k]])[1][0]
        forecast = guess * (float(values.std()) or 1.0) + values.mean() if np.isfinite(value[k]) else np.full(steps, np.nan)
        out.append(Smoothed(forecast, float(value[k]), p[k], float(step[k].max()), int(rounds[k])))
    return out


def _smoothing(season: int):
    def many(histories: list[np.ndarray], steps: int) -> list[np.ndarray]:
        """Forecasts; of a search that has not converged none."""
        return [f.forecast if f.reason is None else np.full(steps, np.nan) for f in fit_smoothing(histories, steps, season)]

    return many


SEASONS = {"holt_damped": 0, "holt_winters_add_damped": 12}


def smoothing_status(series: DataFrame, origins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, unit_id, origin, candidate_id, status, reason, rounds, final_step: how the search of each smoothing method ended at each
    origin. What has failed there has null predictions in ``grouped_forecasts``, so the candidate is not complete."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    names = [*keys, "role", "unit_id", "origin", "candidate_id", "status", "reason", "rounds", "final_step"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", role string, unit_id string, origin int, candidate_id string, status string, reason string, rounds int, final_step double"

    def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        values = rows.sort_values("t")["value"].to_numpy(float)
        asked = list(wanted.itertuples(index=False)) if len(values) else []
        for name, season in SEASONS.items():
            needs = next(m.needs for m in METHODS if m.id == name)
            able = [r for r in asked if needs <= r.origin <= len(values)]
            for r, f in zip(able, fit_smoothing([values[: r.origin] for r in able], 1, season) if able else (), strict=True):
                out.append((*(rows[k].iloc[0] for k in keys), r.role, r.unit_id, r.origin, name, "failed" if f.reason else "converged", f.reason, f.rounds, f.step))
        return pd.DataFrame(out, columns=names)

    wanted = origins.select(*[F.col(k).alias(f"__{k}") for k in keys], "role", "unit_id", "origin")
    return series.groupBy(*keys).cogroup(wanted.groupBy(*[f"__{k}" for k in keys])).applyInPandas(run, schema)


METHODS = (
    ForecastMethod("last_value", 0, 2, True, True),
    ForecastMethod("historical_mean", 1, 2, True, True),
    ForecastMethod("seasonal_naive", 2, 24, True, True),
    ForecastMethod("linear_trend", 3, 12, True, False),
    ForecastMethod("ridge_trend_month", 4, 24, True, False, ridge_trend_month),
    ForecastMethod("holt_damped", 5, 12, False, False, many=_smoothing(0)),
    ForecastMethod("holt_winters_add_damped", 6, 36, False, False, many=_smoothing(12)),
)
SQL_METHODS = tuple(m.id for m in METHODS if m.by_sums)


def backtest_plan(lengths: DataFrame, keys: list[str], horizon: int, depth: str = "recommended") -> DataFrame:
    """lengths (keys, n) → keys, n, w, has_holdout, d, k, evaluable. The shortest history w is 36, 24, 12 or 2 months."""
    h, n = F.lit(horizon), F.col("n")
    w = F.coalesce(*[F.when(n >= x + 3 * horizon, F.lit(x)) for x in (36, 24, 12, 2)])
    p = lengths.withColumn("w", w).withColumn("has_holdout", F.coalesce(n >= F.col("w") + 4 * horizon, F.lit(False)))
    p = p.withColumn("d", F.when(F.col("has_holdout"), n - h).otherwise(n))
    p = p.withColumn("w", F.coalesce("w", F.lit(2)))
    k = F.least(F.lit(3 if depth == "quick" else 6), F.floor((F.col("d") - F.col("w")) / horizon))
    p = p.withColumn("k", F.greatest(k, F.lit(0)).cast("int"))
    return p.select(*keys, F.col("n").cast("int").alias("n"), F.col("w").cast("int").alias("w"), "has_holdout", F.col("d").cast("int").alias("d"), "k", ((n >= horizon + 2) & (F.col("k") >= 1)).alias("evaluable"))


def plan_origins(plan: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """keys, role, unit_id, origin: one row per backtest origin, reserved test and future of each evaluable series."""
    ok = plan.where("evaluable")
    folds = ok.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(*keys, F.lit("selection_backtest").alias("role"), F.concat(F.lit("origin-"), (F.col("j") + 1).cast("string")).alias("unit_id"), (F.col("d") - F.col("k") * horizon + F.col("j") * horizon).cast("int").alias("origin"))
    test = ok.where("has_holdout").select(*keys, F.lit("final_test").alias("role"), F.lit("test").alias("unit_id"), F.col("d").alias("origin"))
    future = ok.select(*keys, F.lit("forecast_future").alias("role"), F.lit("future").alias("unit_id"), F.col("n").alias("origin"))
    return folds.unionByName(test).unionByName(future)


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def sql_forecasts(series: DataFrame, origins: DataFrame, keys: list[str], horizon: int, methods: tuple[str, ...] = SQL_METHODS) -> DataFrame:
    """keys, role, unit_id, origin, candidate_id, horizon, t, predicted for the methods that running sums express."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v, t = F.col("value"), F.col("t").cast("double")
    n = F.col("t") + 1
    mean = F.sum(v).over(w) / n
    st, stt, stv = F.sum(t).over(w), F.sum(t * t).over(w), F.sum(t * v).over(w)
    slope = (n * stv - st * F.sum(v).over(w)) / F.nullif(n * stt - st * st, F.lit(0.0))
    state = series.select(*keys, (F.col("t") + 1).alias("origin"), v.alias("last"), mean.alias("mean"), slope.alias("slope"), (mean - slope * st / n).alias("start"))
    at = _steps(origins.join(state, [*keys, "origin"]), horizon).withColumn("t", (F.col("origin") + F.col("horizon") - 1).cast("int"))
    needs = {m.id: m.needs for m in METHODS}
    value = {"last_value": F.col("last"), "historical_mean": F.col("mean"), "linear_trend": F.col("start") + F.col("slope") * F.col("t")}
    base = [*keys, "role", "unit_id", "origin", "horizon", "t"]
    flat = [F.struct(F.lit(m).alias("candidate_id"), value[m].alias("predicted"), F.lit(needs[m]).alias("needs")) for m in methods if m in value]
    out = at.select(*base, F.explode(F.array(*flat)).alias("x")).select(*base, "x.*") if flat else None
    if "seasonal_naive" in methods:
        back = at.withColumn("s", (F.col("origin") - 12 + (F.col("horizon") - 1) % 12).cast("int"))
        seas = back.join(series.select(*keys, F.col("t").alias("s"), F.col("value").alias("predicted")), [*keys, "s"]).select(*base, F.lit("seasonal_naive").alias("candidate_id"), "predicted", F.lit(needs["seasonal_naive"]).alias("needs"))
        out = seas if out is None else out.unionByName(seas)
    return out


def grouped_forecasts(series: DataFrame, origins: DataFrame, keys: list[str], horizon: int, methods: tuple[ForecastMethod, ...]) -> DataFrame:
    """The same rows for methods that are functions of a series' prefix; a method that fails gives null predictions."""
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", role string, unit_id string, origin int, horizon int, t int, candidate_id string, predicted double, needs int"

    def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values("t")
        values, months = rows["value"].to_numpy(float), pd.to_datetime(rows["month"]).dt.month.to_numpy() - 1
        if not len(rows):
            return pd.DataFrame(out, columns=[*keys, "role", "unit_id", "origin", "horizon", "t", "candidate_id", "predicted", "needs"])
        key = [rows[k].iloc[0] for k in keys]
        asked = list(wanted.itertuples(index=False))
        for m in methods:
            guesses = {k: np.full(horizon, np.nan) for k in range(len(asked))}
            able = [k for k, r in enumerate(asked) if m.needs <= r.origin <= len(values)]
            try:
                if m.many is not None:
                    guesses |= dict(zip(able, m.many([values[: asked[k].origin] for k in able], horizon), strict=True)) if able else {}
                else:
                    guesses |= {k: np.asarray(m.fit_predict(values[: asked[k].origin], months[: asked[k].origin], horizon), float) for k in able}
            except (ArithmeticError, ValueError, np.linalg.LinAlgError):
                pass
            for k, r in enumerate(asked):
                ok = guesses[k].shape == (horizon,) and np.isfinite(guesses[k]).all()
                out += [(*key, r.role, r.unit_id, r.origin, h + 1, r.origin + h, m.id, float(guesses[k][h]) if ok else None, m.needs) for h in range(horizon)]
        return pd.DataFrame(out, columns=[*keys, "role", "unit_id", "origin", "horizon", "t", "candidate_id", "predicted", "needs"])

    # the origins stem from the series themselves, so their keys get names of their own
    wanted = origins.select(*[F.col(k).alias(f"__{k}") for k in keys], "role", "unit_id", "origin")
    return series.groupBy(*keys).cogroup(wanted.groupBy(*[f"__{k}" for k in keys])).applyInPandas(run, schema)


def backtest(series: DataFrame, keys: list[str], horizon: int, depth: str = "recommended", methods: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, predictions): every eligible method at every origin; actual is null in the future. A method is eligible if the shortest
    prefix of the series' backtest is long enough for it."""
    chosen = [m for m in METHODS if (m.quick or depth != "quick") and (methods is None or m.id in methods)]
    lengths = series.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    plan = backtest_plan(lengths, keys, horizon, depth)
    origins = plan_origins(plan, keys, horizon)
    pred = sql_forecasts(series, origins, keys, horizon, tuple(m.id for m in chosen if m.by_sums))
    grouped = tuple(m for m in chosen if not m.by_sums)
    if grouped:
        more = grouped_forecasts(series, origins, keys, horizon, grouped)
        pred = pred.unionByName(more) if pred is not None else more
    shortest = plan.where("evaluable").select(*keys, (F.col("d") - F.col("k") * horizon).alias("shortest"))
    pred = pred.join(shortest, keys).where(F.col("shortest") >= F.col("needs")).drop("shortest", "needs")
    known = series.select(*keys, "t", F.col("value").alias("actual"))
    return plan, pred.join(known, [*keys, "t"], "left")


def backtest_metrics(pred: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(joint: keys, candidate_id, mae, rmse, n and sums; units: the same by unit_id) over the selection backtest."""
    scored = pred.where(F.col("role") == "selection_backtest")
    return regression_sums(scored, [*keys, "candidate_id"]), regression_sums(scored, [*keys, "candidate_id", "unit_id"])


def select_forecast(plan: DataFrame, pred: DataFrame, series: DataFrame, keys: list[str], metric: str = "mae") -> DataFrame:
    """keys, selected_id, best_observed_id, baseline_id, passing. The baseline is the best completed reference; with fewer than three origins
    nothing may replace it."""
    joint, units = backtest_metrics(pred, keys)
    failed = pred.where((F.col("role") == "selection_backtest") & F.col("predicted").isNull()).select(*keys, "candidate_id").distinct().withColumn("failed", F.lit(True))
    rank = F.create_map(*[F.lit(x) for m in METHODS for x in (m.id, m.complexity)])
    joint = joint.join(failed, [*keys, "candidate_id"], "left").select(*keys, "candidate_id", F.when(F.col("failed").isNull(), F.col(metric)).alias("primary_value"), rank[F.col("candidate_id")].alias("complexity"), F.when(F.col("failed").isNull(), "completed").otherwise("failed").alias("status"))
    refs = joint.where(F.col("candidate_id").isin(*[m.id for m in METHODS if m.reference]) & (F.col("status") == "completed"))
    first = Window.partitionBy(*keys).orderBy("primary_value", "complexity", "candidate_id")
    baseline = refs.withColumn("r", F.row_number().over(first)).where(F.col("r") == 1).select(*keys, "candidate_id")
    # development months alone: the reserved test must not reach the choice
    scale = series.join(plan.select(*keys, "d"), keys).where(F.col("t") < F.col("d")).groupBy(*keys).agg(F.max(F.abs("value")).alias("scale"))
    context = plan.select(*keys, (F.col("k") < 3).alias("few")).join(scale, keys)
    judged = judge_candidates(joint.join(context, keys), units.select(*keys, "candidate_id", "unit_id", F.col(metric).alias("value")), baseline, metric, "min", F.col("scale"), F.col("few"), keys)
    return select_candidate(judged, "min", keys)


def forecast_future(pred: DataFrame, decision: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, selected_id, target_month, horizon, predicted, fallback: the selected method on the whole series; where it fails the
    baseline's forecast stands in."""
    last = series.groupBy(*keys).agg(F.max("month").alias("last"), (F.max("t") + 1).alias("n"))
    future = pred.where(F.col("role") == "forecast_future").select(*keys, "candidate_id", "horizon", "predicted")
    chosen = decision.select(*keys, "selected_id", "baseline_id")
    mine = chosen.join(future.withColumnRenamed("candidate_id", "selected_id"), [*keys, "selected_id"])
    base = future.select(*keys, F.col("candidate_id").alias("baseline_id"), "horizon", F.col("predicted").alias("base"))
    out = mine.join(base, [*keys, "baseline_id", "horizon"], "left").join(last, keys)
    return out.select(*keys, "selected_id", F.add_months("last", F.col("horizon")).alias("target_month"), "horizon", F.coalesce("predicted", "base").alias("predicted"), F.col("predicted").isNull().alias("fallback"))


def horizon_stability(pred: DataFrame, decision: DataFrame, keys: list[str]) -> DataFrame:
    """keys, horizon, n, selected_mae, baseline_mae, improvement, verdict, warning: steps of unequal counts are left out; the warning is set
    for a series with at least a third of its steps over 10 % worse."""
    scored = pred.where((F.col("role") == "selection_backtest") & F.col("predicted").isNotNull())
    side = lambda name: scored.join(decision.select(*keys, F.col(f"{name}_id").alias("candidate_id")), [*keys, "candidate_id"]).groupBy(*keys, "horizon").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias(f"{name}_mae"))
    j = side("selected").join(side("baseline"), [*keys, "horizon"]).where(F.col("selected_n") == F.col("baseline_n"))
    gain = (F.col("baseline_mae") - F.col("selected_mae")) / F.nullif(F.col("baseline_mae"), F.lit(0.0))
    j = j.withColumn("improvement", gain).withColumn("verdict", F.when(F.col("improvement") > 0.1, "better").when(F.col("improvement") < -0.1, "worse").otherwise("similar"))
    w = Window.partitionBy(*keys)
    warn = F.count_if(F.col("verdict") == "worse").over(w) >= F.ceil(F.count(F.lit(1)).over(w) / 3)
    return j.select(*keys, "horizon", F.col("selected_n").alias("n"), "selected_mae", "baseline_mae", "improvement", "verdict", F.when(warn, "HORIZON_PERFORMANCE_VARIES").alias("warning"))


def extrapolation_flags(future: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, horizon, predicted, extrapolates: outside the series' range by more than three interquartile ranges."""
    q = series.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("value").alias("a"), F.max("value").alias("b"), F.max(F.abs("value")).alias("m"))
    room = 3 * F.greatest(F.col("q")[1] - F.col("q")[0], F.greatest(F.lit(1e-12), F.col("m") * 1e-12))
    return future.join(q, keys).select(*keys, "horizon", "predicted", ((F.col("predicted") < F.col("a") - room) | (F.col("predicted") > F.col("b") + room)).alias("extrapolates"))


def prediction_roles(series: DataFrame, pred: DataFrame, decision: DataFrame, keys: list[str]) -> DataFrame:
    """History, backtest, test and future of the selected method as one long table."""
    from tallywright.operators.tables import union_roles

    history = series.select(*keys, F.lit("history").alias("role"), F.lit(None).cast("string").alias("unit_id"), "t", F.col("value").alias("actual"), F.lit(None).cast("double").alias("predicted"))
    mine = pred.join(decision.select(*keys, F.col("selected_id").alias("candidate_id")), [*keys, "candidate_id"], "left_semi").select(*keys, "role", "unit_id", "t", "actual", "predicted")
    return union_roles(history, mine)
