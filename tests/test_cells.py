"""Forests over cells, and preprocessing that the candidates of a unit share."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tallywright.operators import forests, models


def _rows(spark, copies):
    x = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), F.expr("id div 20 % 20").cast("double").alias("b"))
    x = x.crossJoin(spark.range(copies).select("id")).withColumn("y", F.col("a") * 3 + (F.col("b") > 7).cast("double") * 40 + F.rand(5))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x.withColumn("k", (F.col("y") > 50).cast("double")))


def test_a_forest_on_cells_is_as_good_as_on_rows(spark, monkeypatch):
    df = _rows(spark, 40).cache()
    fitted = []
    for e, label in ((RandomForestRegressor(labelCol="y", seed=3, featureSubsetStrategy="all"), "y"), (RandomForestClassifier(labelCol="k", seed=3), "k")):
        e = e.setNumTrees(6).setMaxDepth(8).setMinInstancesPerNode(2)
        error = F.avg(F.abs(F.col("prediction") - F.col(label)))
        monkeypatch.setattr(type(e), "_fit", lambda self, d, f=type(e)._fit: (fitted.append(d.count()), f(self, d))[1])
        fitted.clear()
        cells = forests.CellForest(e).fit(df).transform(df).agg(error).first()[0]
        assert len(fitted) == 6 and max(fitted) <= 800  # a tree on at most two instances of each of 400 cells, instead of 16,000 rows
        rows = e.fit(df).transform(df).agg(error).first()[0]
        assert abs(cells - rows) < 0.2, (label, cells, rows)


def test_rows_are_drawn_as_often_as_a_bootstrap_draws_them():
    times = forests.drawn(np.random.default_rng(1), 20_000, 10)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.005


def test_candidates_of_a_unit_share_preprocessing(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(models, "learn_inputs", lambda train, *a, f=models.learn_inputs: (learned.append(1), f(train, *a))[1])
    df = spark.range(60).select("id", F.col("id").alias("block"), (F.col("id") * 2.0).alias("a"), F.col("id").cast("double").alias("y"))
    folds = spark.range(60).select(F.col("id").alias("block"), (F.col("id") % 2 + 1).cast("int").alias("fold"))
    specs = [s for s in models.MODELS if s.id == "ridge"]
    bad = models.ModelSpec("refuses", 9, "regression", 2, True, lambda seed, n, sd: specs[0].build(seed, n, sd).setMaxIter(-1))
    told = models.evaluate(df, folds, "block", "id", "y", "regression", [*specs, bad], ["a"], [], 2)[2]
    assert len(learned) == 2 and sorted(r.status for r in told.collect()) == ["completed"] * 2 + ["failed"] * 2
