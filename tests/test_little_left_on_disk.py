"""importance keeps no more on disk than one repeat of one unit needs, and a written table leaves no shuffle files."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallywright import staging
from tallywright.operators import models, splits


def _files(spark, kind):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, names in os.walk(str(d)) for f in names if f.startswith(kind)}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _files(spark, "shuffle_")
    table = staging.materialize(spark.range(20_000).repartition(3, "id"), "some")
    assert not _files(spark, "shuffle_") - before
    assert table.count() == 20_000 and spark.conf.get(staging.SHUFFLES_GO) == "false"


def test_repeats_leave_their_values_only(spark, monkeypatch):
    held, most, write = [], [], models.materialize

    def counted(df, name="stage", outer=False):
        out = write(df, name, outer)
        held.append(out.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
        most.append(sum(os.path.exists(p) for p in held))
        return out

    monkeypatch.setattr(models, "materialize", counted)
    monkeypatch.setattr(models, "COPIES_AT_ONCE", 200)  # fewer than two repeats of a unit have
    monkeypatch.setattr("tallywright.operators.tables.materialize", counted)
    x = F.col("id") * 37 % 101
    df = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").alias("block"), x.cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (x * 3.0).alias("y"))
    folds = splits.group_folds(df, "block", 2, 1)
    _, fitted, _ = models.evaluate(df, folds, "block", "row_id", "y", "regression", [next(s for s in models.MODELS if s.id == "ridge")], ["a", "b"], [], 2)
    part = df.join(folds, "block").withColumn("unit_id", F.concat(F.lit("fold-"), F.col("fold").cast("string")))
    held.clear(), most.clear()
    got = {r.feature: r for r in models.permutation_importance({u: m for (_, u), m in fitted.items()}, part, ["a", "b"], ["a", "b"], "regression", "y").collect()}
    assert got["a"].n == got["b"].n == 6 and got["a"].importance > 10 * abs(got["b"].importance)
    tables = [p for p in held if p.endswith("/numbered")]
    assert len(tables) == 12 and not any(map(os.path.exists, tables))  # two a repeat and unit, each gone
    assert max(most) <= 2 + 8  # the present ones, and values: a table a repeat and one a unit


def test_rows_are_dealt_the_same_one_repeat_at_a_time(spark):
    rows = spark.range(700).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("a")).repartition(3)
    together = {tuple(r) for r in models.permuted(rows, "row_id", ["a"], 3).collect()}
    assert together == {tuple(r) for k in range(3) for r in models.dealt(rows, "row_id", ["a"], [k], 42).collect()} and len(together) == 2100
