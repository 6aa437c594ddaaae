"""Rows that share a key are not brought together for it: joins with few wide-spread keys send the small side to the rows."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallywright.operators import models as ml
from tallywright.operators import quantiles


@contextmanager
def nothing_broadcast_unasked(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_do_not_gather_a_key(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("key"), (F.col("id") % 50).cast("double").alias("v"))
    with nothing_broadcast_unasked(spark):
        assert "SortMergeJoin" not in plan(quantiles.exact_quantiles(rows, [0.5]))


@pytest.mark.parametrize("most", [10_000, 0])
def test_quantiles_with_few_and_with_many_keys(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_KEYS", most)
    key = F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("key")
    rows = spark.range(3000).select(key, (F.col("id") * 7919 % 1013).cast("double").alias("v"))
    want = {r["key"]: r["q"] for r in rows.groupBy("key").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q")).collect()}
    got = {r["key"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(rows, [0.01, 0.5, 0.99]).collect()}
    assert set(got) == {None, "1", "2"}
    for k, (n, q) in got.items():
        assert n == 1000 and q == pytest.approx(want[k])


def test_requests_are_not_gathered_by_column(spark):
    controls = spark.createDataFrame([("a", "numeric", 0.0, 9.0, None), ("b", "category", None, None, "x")], "column_id string, kind string, low double, high double, option string")
    requests = spark.createDataFrame([(1, "a", "10"), (2, "b", "x"), (3, "b", "y"), (4, "c", "1"), (5, "a", "many")], "scenario_id long, column_id string, value string")
    with nothing_broadcast_unasked(spark):
        told = ml.validate_scenarios(requests, controls)
        assert "SortMergeJoin" not in plan(told)
        assert {r["scenario_id"]: r["reason"] for r in told.collect()} == {1: "OUT_OF_RANGE", 2: None, 3: "NOT_AN_OPTION", 4: "UNKNOWN_COLUMN", 5: "NOT_A_NUMBER"}
