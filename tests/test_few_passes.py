"""A ridge is solved in one pass over the rows, and a use that needs some units only has no others fitted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.operators import models as ml
from tallywright.operators import splits

RIDGE = next(s for s in ml.MODELS if s.id == "ridge")


@pytest.fixture(scope="module")
def rows(spark):
    x = (F.col("id") * 37 % 101).cast("double")
    return spark.range(300).select(F.col("id").alias("row_id"), F.col("id").alias("block"), x.alias("x"), (x * 3 + F.col("id") % 7).alias("y")).localCheckpoint()


def test_ridge_takes_no_search(spark, rows):
    train = ml.with_inputs(rows, ["x"], "regression", "y")
    spark.sparkContext.setJobGroup("ridge", "ridge")
    try:
        model = ml.fit_model(RIDGE, train, ["x"], [], 1)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ridge"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12  # a search took a job for each step
    got = np.array([r["prediction"] for r in model.transform(train).orderBy("row_id").collect()])
    x, y = (np.array([r[c] for r in rows.orderBy("row_id").collect()]) for c in ("x", "y"))
    z = x / x.std(ddof=1)
    slope = ((z - z.mean()) @ (y - y.mean())) / ((z - z.mean()) @ (z - z.mean()) + 1)
    assert got == pytest.approx(y.mean() + slope * (z - z.mean()), rel=1e-10)


def test_only_the_units_asked_for_are_fitted(rows):
    folds = splits.group_folds(rows, "block", 3, 1)
    pred, models, told = ml.evaluate(rows, folds, "block", "row_id", "y", "regression", [RIDGE], ["x"], [], 3, units=1)
    assert list(models) == [("ridge", "fold-1")] and told.count() == 1
    assert pred.count() == folds.where("fold = 1").count()
