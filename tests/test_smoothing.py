"""The parameter search of the smoothing methods against a grid and random draws of parameters."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import forecast


def short_series():
    rng = np.random.default_rng(11)
    out = [np.cumsum(rng.normal(size=n)) for n in (12, 13, 15)]
    out += [3.0 * np.arange(14) + rng.normal(size=14), rng.normal(size=12) + 50, np.repeat([1.0, 4.0], 7), np.exp(np.arange(12) / 4)]
    return out


def errors(values, season, parameters):
    y = (values - values.mean()) / values.std()
    return forecast._paths(np.repeat(y[:, None], len(parameters), axis=1), np.full(len(parameters), len(y)), 0, season, parameters)[0]


@pytest.mark.parametrize("k", range(7))
def test_no_grid_point_is_better(k):
    values = short_series()[k]
    found = forecast.fit_smoothing([values], 3, 0)[0]
    assert found.reason is None and found.step < forecast.FINAL_STEP
    y = (values - values.mean()) / values.std()
    axes = [np.linspace(0.01, 0.99, 8), np.linspace(0, 0.99, 7), np.linspace(0.8, 0.98, 4), y[0] + np.linspace(-1.2, 1.2, 9), np.linspace(-0.6, 0.6, 9)]
    grid = np.array(list(itertools.product(*axes)))
    assert errors(values, 0, grid).min() >= found.error * 0.998 - 1e-9  # a search that ends at gains of one in a hundred thousand
    assert np.isclose(errors(values, 0, found.parameters[None])[0], found.error)


@pytest.mark.parametrize("n", [36, 40])
def test_no_draw_and_no_small_move_is_better_with_seasons(n):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    values = 100 + 0.7 * t + 8 * np.sin(2 * np.pi * t / 12) + rng.normal(size=n)
    found = forecast.fit_smoothing([values], 6, 12)[0]
    assert found.reason is None
    p = found.parameters
    moves = np.concatenate([np.eye(len(p)), -np.eye(len(p))]) * 2e-4 + p
    moves[:, :4] = np.clip(moves[:, :4], [0.01, 0, 0.8, 0], [0.99, 0.99, 0.98, 0.99])
    assert errors(values, 12, moves).min() >= found.error * (1 - 1e-4)
    draws = p + rng.normal(size=(5000, len(p))) * rng.choice([0.01, 0.1, 0.5], size=(5000, 1))
    draws[:, :4] = np.clip(draws[:, :4], [0.01, 0, 0.8, 0], [0.99, 0.99, 0.98, 0.99])
    assert errors(values, 12, draws).min() >= found.error * 0.998


def test_a_search_that_is_cut_off_has_failed(spark, monkeypatch):
    values = short_series()[0]
    cut = forecast.fit_smoothing([values, np.full(12, np.nan)], 3, 0, most=3)
    assert [f.reason for f in cut] == ["NOT_CONVERGED", "NOT_FINITE"] and cut[0].rounds == 3
    whole = forecast.fit_smoothing
    monkeypatch.setattr(forecast, "fit_smoothing", lambda histories, steps, season: whole(histories, steps, season, 3))
    assert np.isnan(forecast._smoothing(0)([values], 3)[0]).all()


def test_status_of_each_origin(spark):
    rows = [("a", k, float(k + k % 3)) for k in range(40)] + [("b", k, 1.0) for k in range(14)]
    series = spark.createDataFrame(rows, "series_id string, t int, value double")
    origins = series.groupBy("series_id").agg(F.max("t").alias("n")).select("series_id", F.lit("r").alias("role"), F.lit("u").alias("unit_id"), (F.col("n") + 1).cast("int").alias("origin"))
    got = {(r.series_id, r.candidate_id): (r.status, r.reason) for r in forecast.smoothing_status(series, origins, ["series_id"]).collect()}
    assert got == {("a", "holt_damped"): ("converged", None), ("a", "holt_winters_add_damped"): ("converged", None), ("b", "holt_damped"): ("converged", None)}
