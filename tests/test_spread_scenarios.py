"""A scenario becomes many rows: requests that lie in one file are spread before."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import models


def test_points_of_many_scenarios_are_made_by_several_tasks(spark, tmp_path):
    spark.range(60_000).select(F.col("id").alias("scenario_id")).coalesce(1).write.parquet(f"{tmp_path}/requests")
    requests = spark.read.parquet(f"{tmp_path}/requests")
    controls = spark.createDataFrame([("x1", 0.0, 24.0)], "column_id string, low double, high double")
    grid = models.scenario_grid(requests, controls, "x1")
    tasks = grid.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.6 * 25 * 60_000
    told = grid.agg(F.count("*"), F.countDistinct("scenario_id"), F.sum((F.col("x") == F.col("point")).cast("long"))).first()
    assert tuple(told) == (1_500_000, 60_000, 1_500_000)
