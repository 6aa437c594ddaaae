"""Digests, profiles from sketches, and fits under a time budget."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tallywright.functions import hashing
from tallywright.operators import models, profile, splits, tables


def digest(spark, rows, ordered):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "position long, a string, b string").repartition(3)
    return hashing.table_digest(df if ordered else df.drop("position"), "position" if ordered else None).first()


@pytest.mark.parametrize("ordered", [False, True])
def test_digest_tells_nulls_repeats_and_cells_apart(spark, ordered):
    tables_ = ([("a", None)], [(None, "a")], [("a", "")], [("", "a")], [("a", None)] * 2, [("a", None)] * 3, [("ab", "c")], [("a", "bc")], [("1:a", None)], [], [(None, None)], [("a", None), (None, "a")])
    found = [tuple(digest(spark, t, ordered)) for t in tables_]
    assert len(set(found)) == len(found) and found[9] == (0, "0-0")


def test_digest_of_an_order(spark):
    rows = [("a", "1"), ("b", "2"), ("b", "2"), ("c", None)]
    other = [rows[1], rows[0], *rows[2:]]
    assert digest(spark, rows, True) != digest(spark, other, True)
    assert digest(spark, rows, False) == digest(spark, other, False)
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.col("id").cast("string").alias("v"))
    up, same, down = (hashing.table_digest(tables.numbered(d.withColumn("o", o), ["o"]).drop("o"), "position").first() for d, o in ((df, F.col("k")), (df.repartition(5), F.col("k")), (df, -F.col("k"))))
    assert up == same != down


def test_profile_from_sketches_decides_as_exact_counts_do(spark):
    n = 3000
    i = F.col("id")
    df = spark.range(n).select(
        F.concat(F.lit("customer-"), i.cast("string")).alias("all_different"),
        F.concat(F.lit("customer-"), (i % 2941).cast("string")).alias("just_enough"),  # 98.03 %
        F.concat(F.lit("customer-"), (i % 2939).cast("string")).alias("just_short"),  # 97.97 %
        (i % 7).cast("double").alias("few"), F.lit("x").alias("one"), F.lit(None).cast("string").alias("none"),
        F.when(i % 2 == 0, F.lit(-0.0)).otherwise(0.0).alias("zero"), F.when(i > 5, F.lit(float("nan"))).otherwise(1.5).alias("nan"),
        i.alias("order_id"), F.when(i % 3 == 0, i.cast("string")).alias("some_id"),
    )
    exact = {r.column_id: r for r in profile.column_profile(df).collect()}
    near = {r.column_id: r for r in profile.column_profile(df, exact=False).collect()}
    assert {c: r.distinct_count for c, r in exact.items()} == {"all_different": n, "just_enough": 2941, "just_short": 2939, "few": 7, "one": 1, "none": 0, "zero": 1, "nan": 1, "order_id": n, "some_id": 1000}
    for c, r in exact.items():
        assert [near[c][k] for k in r.asDict() if k != "distinct_count"] == [r[k] for k in r.asDict() if k != "distinct_count"], c
        assert math.isclose(near[c].distinct_count, r.distinct_count, rel_tol=0.03)
    assert [exact[c].possible_id for c in ("all_different", "just_enough", "just_short", "order_id", "some_id")] == [True, True, False, True, True]
    plan = profile.column_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_a_fit_over_its_time_is_cancelled(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 50).alias("block"), (F.col("id") % 7).cast("double").alias("a"), F.rand(3).alias("y"))
    folds = splits.group_folds(df, "block", 2, 1)
    specs = {s.id: s for s in models.MODELS}
    pred, fitted, told = models.evaluate(df, folds, "block", "row_id", "y", "regression", [specs["random_forest_regressor"], specs["ridge"]], ["a"], [], 2, most_seconds=0.02)
    assert not fitted and {(r.candidate_id, r.unit_id, r.status) for r in told.collect()} == {(c, u, "timed_out") for c in ("random_forest_regressor", "ridge") for u in ("fold-1", "fold-2")}
    assert pred.count() == 0
    pred, fitted, told = models.evaluate(df, folds, "block", "row_id", "y", "regression", [specs["ridge"]], ["a"], [], 2)
    assert len(fitted) == 2 and pred.count() == 400 and {r.status for r in told.collect()} == {"completed"}


def test_every_value_is_given_once_across_all_rows(spark):
    n = 5000
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("a"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("b")).repartition(6)
    got = models.permuted(rows, "row_id", ["a", "b"], 3).collect()
    by = {k: {r.row_id: r for r in got if r.repeat == k} for k in range(3)}
    for k in range(3):
        assert sorted(by[k]) == sorted(r.donor_id for r in by[k].values()) == list(range(n))
        assert all(r.a == 2 * r.donor_id and r.b == f"v{r.donor_id}" for r in by[k].values())
        far = sum(abs(i - r.donor_id) for i, r in by[k].items()) / n
        assert abs(far - n / 3) < n / 30  # as far apart as two rows drawn at random
        assert sum(i == r.donor_id for i, r in by[k].items()) < 10
    assert sum(by[0][i].donor_id == by[1][i].donor_id for i in range(n)) < 10
    assert {(r.row_id, r.repeat, r.donor_id) for r in models.permuted(rows.repartition(3), "row_id", ["a"], 3).collect()} == {(r.row_id, r.repeat, r.donor_id) for r in got}
