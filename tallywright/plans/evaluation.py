"""Queries over metrics, splits and the selection policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import metrics as M
from tallywright.operators import selection, splits
from tallywright.plans.register import ORACLE_SQL, query, read

_PRED = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_extendedprice AS actual, 1500.0 * l_quantity AS predicted, l_orderkey % 5 AS unit FROM lineitem)"


def _pred(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500.0).alias("predicted"), (F.col("l_orderkey") % 5).alias("unit"))


def _rounded(df, places=4):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("regression_metrics", f"SELECT l_returnflag, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, round(median(abs(predicted - actual)), 4) AS median_ae, round(quantile_cont(abs(predicted - actual), CAST(0.9 AS DOUBLE)), 4) AS p90_ae, round(1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)), 4) AS r2, CAST(NULL AS VARCHAR) AS r2_reason FROM {_PRED} GROUP BY 1")
def regression_metrics(spark, sf):
    return _rounded(M.regression_metrics(_pred(spark, sf), ["l_returnflag"])).drop("wape")


@query("wape", f"SELECT l_returnflag, round(sum(abs(predicted - actual)) / nullif(sum(abs(actual)), 0), 6) AS wape FROM {_PRED} GROUP BY 1")
def wape(spark, sf):
    return _rounded(M.regression_metrics(_pred(spark, sf), ["l_returnflag"]).select("l_returnflag", "wape"), 6)


_CLS = "(SELECT o_orderkey, o_orderstatus AS actual, CASE WHEN o_totalprice > 250000 THEN 'F' WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'P' END AS predicted FROM orders)"


def _classes(spark, sf):
    guess = F.when(F.col("o_totalprice") > 250000, "F").when(F.col("o_orderkey") % 2 == 0, "O").otherwise("P")
    return read(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("actual"), guess.alias("predicted"))


def _labels(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderstatus").alias("label")).distinct()


_L = "(SELECT DISTINCT o_orderstatus AS label FROM orders)"
_CM = f"(SELECT a.label AS actual, b.label AS predicted, count(p.o_orderkey) AS n FROM {_L} a CROSS JOIN {_L} b LEFT JOIN {_CLS} p ON p.actual = a.label AND p.predicted = b.label GROUP BY 1, 2)"
_PC = f"(SELECT l.label, CAST(sum(n) FILTER (WHERE actual = label) AS BIGINT) AS support, CAST(sum(n) FILTER (WHERE predicted = label) AS BIGINT) AS predicted_count, CAST(sum(n) FILTER (WHERE predicted = label AND actual = label) AS BIGINT) AS tp FROM {_L} l, {_CM} GROUP BY 1)"


@query("confusion_matrix", f"SELECT * FROM {_CM}")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(_classes(spark, sf), _labels(spark, sf))


def _per_class(spark, sf):
    return M.class_metrics(confusion_matrix(spark, sf))


@query("class_metrics", f"SELECT label, support, predicted_count, tp, round(CAST(tp AS DOUBLE) / nullif(support, 0), 6) AS recall, round(CAST(tp AS DOUBLE) / nullif(predicted_count, 0), 6) AS precision, round(2.0 * tp / nullif(support + predicted_count, 0), 6) AS f1, CASE WHEN support = 0 THEN 'NO_ACTUAL_CASES' END AS recall_reason, CASE WHEN predicted_count = 0 THEN 'NO_PREDICTED_CASES' END AS precision_reason FROM {_PC}")
def class_metrics(spark, sf):
    return _rounded(_per_class(spark, sf), 6)


_CMET = f"(SELECT CAST(sum(support) AS BIGINT) AS n, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, avg(CAST(tp AS DOUBLE) / nullif(support, 0)) AS balanced_accuracy, avg(2.0 * tp / nullif(support + predicted_count, 0)) AS macro_f1 FROM {_PC})"


@query("classification_metrics", f"SELECT n, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1 FROM {_CMET}")
def classification_metrics(spark, sf):
    return _rounded(M.classification_metrics(_per_class(spark, sf)), 6)


@query("metric_rows", " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value, 'ratio' AS unit, 'final_test' AS role, n, CAST(NULL AS VARCHAR) AS reason FROM {_CMET}" for m in ("accuracy", "balanced_accuracy", "macro_f1")))
def metric_rows(spark, sf):
    return _rounded(M.metric_rows(M.classification_metrics(_per_class(spark, sf)), ["accuracy", "balanced_accuracy", "macro_f1"], [], "final_test"), 6)


@query("unit_distribution", f"SELECT l_returnflag, count(*) AS units, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std, round(max(v) - min(v), 4) AS spread FROM (SELECT l_returnflag, unit, avg(abs(predicted - actual)) AS v FROM {_PRED} GROUP BY 1, 2) GROUP BY 1")
def unit_distribution(spark, sf):
    units = M.regression_metrics(_pred(spark, sf), ["l_returnflag", "unit"]).select("l_returnflag", "unit", F.col("mae").alias("value"))
    return _rounded(M.distribution(units, ["l_returnflag"]))


@query("error_histogram", f"WITH e AS (SELECT predicted - actual AS e FROM {_PRED}), s AS (SELECT CAST(least(40, ceil(sqrt(count(*)))) AS INTEGER) AS bins, min(e) AS lo, max(e) AS hi FROM e), b AS (SELECT least(CAST(floor((e - lo) / ((hi - lo) / bins)) AS INTEGER) + 1, bins) AS bin, count(*) AS n FROM e, s GROUP BY 1) SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(b.n, 0) AS n FROM s, unnest(generate_series(1, s.bins)) g(bin) LEFT JOIN b ON b.bin = g.bin")
def error_histogram(spark, sf):
    return M.error_histogram(_pred(spark, sf)).select("bin", "n")


@query("error_by_horizon", f"SELECT CAST(month(l_shipdate) AS INTEGER) AS horizon, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae FROM {_PRED} GROUP BY 1")
def error_by_horizon(spark, sf):
    return _rounded(M.error_by_horizon(_pred(spark, sf).withColumn("horizon", F.month("l_shipdate"))))


@query("class_support", "SELECT o_orderstatus AS label, count(*) AS n, min(count(*)) OVER () AS smallest FROM orders GROUP BY 1")
def class_support(spark, sf):
    return M.class_support(read(spark, sf, "orders"), "o_orderstatus")


@query("metric_trajectory", f"WITH u AS (SELECT l_returnflag, unit + 1 AS unit_order, count(*) AS c, sum(abs(predicted - actual)) AS a FROM {_PRED} GROUP BY 1, 2) SELECT l_returnflag, unit_order, CAST(sum(c) OVER w AS BIGINT) AS n, round(sum(a) OVER w / sum(c) OVER w, 4) AS value FROM u WINDOW w AS (PARTITION BY l_returnflag ORDER BY unit_order)")
def metric_trajectory(spark, sf):
    return _rounded(M.metric_trajectory(_pred(spark, sf).withColumn("unit_order", F.col("unit") + 1), ["l_returnflag"]))


def _trajectory(value: str) -> str:
    """Running class sums of two candidates over ten units, the second always guessing F; the first beside it."""
    both = f"(SELECT 'rule' AS c, actual, predicted, o_orderkey % 10 + 1 AS u FROM {_CLS} UNION ALL SELECT 'always', actual, 'F', o_orderkey % 10 + 1 FROM {_CLS})"
    runs = f"(SELECT b.c, g.u, l.label, count(*) FILTER (WHERE b.actual = l.label) AS s, count(*) FILTER (WHERE b.predicted = l.label) AS p, count(*) FILTER (WHERE b.actual = l.label AND b.predicted = l.label) AS t FROM {both} b JOIN range(1, 11) g(u) ON b.u <= g.u, {_L} l GROUP BY 1, 2, 3)"
    return f"WITH r AS (SELECT c, u, CAST(sum(s) AS BIGINT) AS n, {value} AS v FROM {runs} GROUP BY 1, 2) SELECT CAST(a.u AS BIGINT) AS unit_order, a.n, round(a.v, 6) AS value, round(b.v, 6) AS baseline_value FROM r a JOIN r b ON a.u = b.u AND a.c = 'rule' AND b.c = 'always'"


def _class_trajectory(spark, sf, metric):
    rule = _classes(spark, sf).withColumn("candidate_id", F.lit("rule"))
    both = rule.unionByName(rule.withColumn("candidate_id", F.lit("always")).withColumn("predicted", F.lit("F"))).withColumn("unit_order", F.col("o_orderkey") % 10 + 1)
    runs = M.class_trajectory(both, ["candidate_id"], _labels(spark, sf), metric)
    return _rounded(M.beside_baseline(runs, "candidate_id", "always").drop("candidate_id"), 6)


@query("trajectory_macro_f1", _trajectory("CASE WHEN count(*) FILTER (WHERE s + p = 0) = 0 THEN avg(2.0 * t / nullif(s + p, 0)) END"))
def trajectory_macro_f1(spark, sf):
    return _class_trajectory(spark, sf, "macro_f1")


@query("trajectory_balanced_accuracy", _trajectory("CASE WHEN count(*) FILTER (WHERE s = 0) = 0 THEN avg(CAST(t AS DOUBLE) / nullif(s, 0)) END"))
def trajectory_balanced_accuracy(spark, sf):
    return _class_trajectory(spark, sf, "balanced_accuracy")


# --- splits: one block per customer ---------------------------------------------------------------------------------------------

_ORD = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)"
_FOLD = f"(SELECT o_custkey AS block, ntile(5) OVER (ORDER BY sha256('42:' || CAST(o_custkey AS VARCHAR))) AS fold FROM (SELECT DISTINCT o_custkey FROM {_ORD}))"


def _folds(spark, sf):
    return splits.group_folds(read(spark, sf, "orders"), "o_custkey", 5, 42)


@query("group_folds", f"SELECT block, CAST(fold AS INTEGER) AS fold FROM {_FOLD}")
def group_folds(spark, sf):
    return _folds(spark, sf)


@query("split_membership", f"SELECT 'fold-' || u AS unit_id, CASE WHEN f.fold = u THEN 'validation' ELSE 'train' END AS part, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey, range(1, 6) t(u) GROUP BY 1, 2")
def split_membership(spark, sf):
    orders = read(spark, sf, "orders")
    return splits.materialize_splits(orders, _folds(spark, sf), "o_custkey", "o_orderkey", 5).groupBy("unit_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("keys"))


@query("split_leakage", f"SELECT count(*) AS leaking FROM (SELECT block FROM {_FOLD} GROUP BY 1 HAVING count(DISTINCT fold) > 1)")
def split_leakage(spark, sf):
    made = splits.materialize_splits(read(spark, sf, "orders"), _folds(spark, sf), "o_custkey", "o_orderkey", 5)
    return splits.leaking_blocks(made).agg(F.count(F.lit(1)).alias("leaking"))


@query("holdout_counts", f"WITH m AS (SELECT count(*) AS rows, count(*) FILTER (WHERE f.fold = 1) AS reserved_rows FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey) SELECT rows, reserved_rows, rows - reserved_rows AS kept_rows, rows >= 200 AND reserved_rows >= 40 AND rows - reserved_rows >= 100 AS used, CASE WHEN rows < 200 THEN 'TOO_FEW_ROWS' WHEN reserved_rows < 40 OR rows - reserved_rows < 100 THEN 'HOLDOUT_TOO_SMALL' END AS reason FROM m")
def holdout_counts(spark, sf):
    return splits.reserve_holdout(read(spark, sf, "orders"), "o_custkey", "o_totalprice", "regression", 42)[1]


@query("stratified_folds", "SELECT o_orderstatus AS label, CAST(fold AS INTEGER) AS fold, count(*) AS blocks, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey, o_orderstatus, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR))) AS fold FROM orders) GROUP BY 1, 2")
def stratified_folds(spark, sf):
    folds = splits.stratified_folds(read(spark, sf, "orders"), "o_orderkey", "o_orderstatus", 5, 7)
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("blocks"), F.sum("block").alias("keys"))


@query("confirmation_folds", f"SELECT CAST(fold AS INTEGER) AS fold, count(*) AS blocks, CAST(sum(o_custkey) AS BIGINT) AS keys FROM (SELECT o_custkey, ntile(3) OVER (ORDER BY sha256('{splits.confirmation_seed(42, 'regression')}:' || CAST(o_custkey AS VARCHAR))) AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) GROUP BY 1")
def confirmation_folds(spark, sf):
    folds = splits.confirmation_splits(read(spark, sf, "orders"), "o_custkey", "o_totalprice", "regression", 42)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("blocks"), F.sum("block").alias("keys"))


@query("target_missing", "SELECT count(*) FILTER (WHERE c_custkey % 10 = 0) AS missing, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS kept FROM customer")
def target_missing(spark, sf):
    return splits.evaluable_rows(read(spark, sf, "customer").withColumn("y", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))), "y", "regression")[1]


def _base_sql(agg: str, target: str) -> str:
    return f"WITH r AS (SELECT o.*, f.fold FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey), l AS (SELECT u AS fold, {agg} AS predicted FROM r, range(1, 6) t(u) WHERE r.fold <> u GROUP BY u) SELECT 'fold-' || r.fold AS unit_id, count(*) AS n, any_value({target}) AS predicted FROM r JOIN l ON l.fold = r.fold GROUP BY 1"


def _baseline(spark, sf, target, how):
    return splits.reference_predictions(read(spark, sf, "orders"), _folds(spark, sf), "o_custkey", "o_orderkey", target, how, 5)


@query("baseline_median", _base_sql("median(o_totalprice)", "round(predicted, 4)"))
def baseline_median(spark, sf):
    return _baseline(spark, sf, "o_totalprice", "median").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("predicted"), 4).alias("predicted"))


@query("baseline_mean", _base_sql("avg(o_totalprice)", "round(predicted, 4)"))
def baseline_mean(spark, sf):
    return _baseline(spark, sf, "o_totalprice", "mean").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("predicted"), 4).alias("predicted"))


@query("baseline_mode", f"WITH r AS (SELECT o.*, f.fold FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey), c AS (SELECT u AS fold, o_orderstatus, count(*) AS n FROM r, range(1, 6) t(u) WHERE r.fold <> u GROUP BY 1, 2), l AS (SELECT fold, o_orderstatus AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, o_orderstatus) = 1) SELECT 'fold-' || r.fold AS unit_id, count(*) AS n, any_value(predicted) AS predicted FROM r JOIN l ON l.fold = r.fold GROUP BY 1")
def baseline_mode(spark, sf):
    return _baseline(spark, sf, "o_orderstatus", "mode").groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.max("predicted").alias("predicted"))


@query("prediction_checks", f"SELECT 'fold-' || f.fold AS unit_id, count(*) AS expected, count(*) FILTER (WHERE o_orderkey % 100 <> 0) AS found, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS outside FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey GROUP BY 1")
def prediction_checks(spark, sf):
    made = splits.materialize_splits(read(spark, sf, "orders"), _folds(spark, sf), "o_custkey", "o_orderkey", 5)
    return splits.prediction_checks(_baseline(spark, sf, "o_totalprice", "mean").where(F.col("row_id") % 100 != 0), made)


@query("eligibility", f"WITH s AS (SELECT min(n) AS shortest FROM (SELECT u, count(*) AS n FROM {_ORD} o JOIN {_FOLD} f ON f.block = o.o_custkey, range(1, 6) t(u) WHERE f.fold <> u GROUP BY u)) SELECT candidate_id, needs <= shortest AS eligible, CASE WHEN needs > shortest THEN 'TRAIN_TOO_SHORT' END AS reason FROM s, (VALUES ('dummy_median', 1), ('ridge', 2), ('random_forest_regressor', 20), ('needs_many', 100000000)) c(candidate_id, needs)")
def eligibility(spark, sf):
    orders = read(spark, sf, "orders")
    wanted = spark.createDataFrame([("dummy_median", 1, False), ("ridge", 2, True), ("random_forest_regressor", 20, True), ("needs_many", 100_000_000, True)], "candidate_id string, needs_rows int, uses_features boolean")
    made = splits.materialize_splits(orders, _folds(spark, sf), "o_custkey", "o_orderkey", 5)
    return splits.eligibility(wanted, made, 3, orders.count(), "regression")


# --- selection: candidates are multiples of the quantity as price, units are five folds of orders ---------------------------------

_CANDS = {"base": (1000.0, 0), "near": (1010.0, 1), "good": (1480.0, 2), "better": (1500.0, 4)}
_ALL = " UNION ALL ".join(f"SELECT '{c}' AS candidate_id, {k} AS complexity, l_orderkey % 5 AS unit, l_extendedprice AS actual, {f} * l_quantity AS predicted FROM lineitem" for c, (f, k) in _CANDS.items())
_UNITS = f"(SELECT candidate_id, 'unit-' || unit AS unit_id, avg(abs(predicted - actual)) AS value FROM ({_ALL}) GROUP BY 1, 2)"
_JOINT = f"(SELECT candidate_id, any_value(complexity) AS complexity, avg(abs(predicted - actual)) AS primary_value FROM ({_ALL}) GROUP BY 1)"


def _candidates(spark, sf):
    """(candidates, unit metrics) of a few multiples, in one pass over the lines."""
    item = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("unit"), F.col("l_extendedprice").alias("actual"), "l_quantity")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate_id"), F.lit(k).alias("complexity"), F.lit(f).alias("f")) for c, (f, k) in _CANDS.items()])).alias("c")
    pred = item.select("unit", "actual", "l_quantity", each).select("c.candidate_id", "c.complexity", "unit", "actual", (F.col("c.f") * F.col("l_quantity")).alias("predicted"))
    joint = pred.groupBy("candidate_id", "complexity").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("primary_value")).withColumn("status", F.lit("completed"))
    units = pred.groupBy("candidate_id", F.concat(F.lit("unit-"), F.col("unit").cast("string")).alias("unit_id")).agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("value"))
    return joint, units, joint.where(F.col("candidate_id") == "base")


@query("paired_units", f"SELECT u.candidate_id, u.unit_id, round(u.value, 4) AS value, round(b.value, 4) AS baseline_value, round(b.value - u.value, 4) AS gain, CAST(NULL AS VARCHAR) AS reason FROM {_UNITS} u JOIN {_UNITS} b ON b.unit_id = u.unit_id AND b.candidate_id = 'base'")
def paired_units(spark, sf):
    joint, units, base = _candidates(spark, sf)
    return _rounded(selection.pair_units(units, base, "min"))


@query("candidate_ranking", f"SELECT candidate_id, CAST(row_number() OVER (ORDER BY primary_value, complexity, candidate_id) AS INTEGER) AS rank FROM {_JOINT}")
def candidate_ranking(spark, sf):
    return selection.rank_candidates(_candidates(spark, sf)[0], "min").select("candidate_id", "rank")


_GAINS = f"(SELECT u.candidate_id, count(*) AS pairs, count(*) FILTER (WHERE b.value - u.value > 1e-6) AS wins, median(b.value - u.value) AS mg FROM {_UNITS} u JOIN {_UNITS} b ON b.unit_id = u.unit_id AND b.candidate_id = 'base' GROUP BY 1)"
_JUDGED = f"(SELECT j.*, b.primary_value AS bv, b.primary_value - j.primary_value AS joint_gain, g.pairs, g.wins, g.mg, j.candidate_id <> 'base' AND b.primary_value - j.primary_value + 1e-6 >= 0.03 * b.primary_value AND g.pairs >= 3 AND g.wins >= ceil(0.6 * g.pairs) AND g.mg > 1e-6 AS passes FROM {_JOINT} j JOIN {_JOINT} b ON b.candidate_id = 'base' JOIN {_GAINS} g ON g.candidate_id = j.candidate_id)"


@query("selection_gate", f"SELECT candidate_id, round(joint_gain, 4) AS joint_gain, pairs, wins, passes FROM {_JUDGED}")
def selection_gate(spark, sf):
    joint, units, base = _candidates(spark, sf)
    return _rounded(selection.judge_candidates(joint, units, base, "mae", "min", 1e6).select("candidate_id", "joint_gain", "pairs", "wins", "passes"))


@query("selection_decision", f"WITH j AS {_JUDGED}, b AS (SELECT min(primary_value) AS best FROM j WHERE passes) SELECT coalesce((SELECT candidate_id FROM j, b WHERE passes AND primary_value <= best + 0.01 * bv + 1e-6 ORDER BY complexity, primary_value, candidate_id LIMIT 1), 'base') AS selected_id, (SELECT candidate_id FROM j ORDER BY primary_value, complexity, candidate_id LIMIT 1) AS best_observed_id, 'base' AS baseline_id, count(*) FILTER (WHERE passes) AS passing FROM j")
def selection_decision(spark, sf):
    joint, units, base = _candidates(spark, sf)
    return selection.select_candidate(selection.judge_candidates(joint, units, base, "mae", "min", 1e6), "min")


@query("confirmation_decision", f"WITH u AS (SELECT b.value - c.value AS gain FROM {_UNITS} c JOIN {_UNITS} b ON b.unit_id = c.unit_id AND b.candidate_id = 'base' WHERE c.candidate_id = 'good'), j AS (SELECT b.primary_value AS bv, b.primary_value - c.primary_value AS g FROM {_JOINT} b, {_JOINT} c WHERE b.candidate_id = 'base' AND c.candidate_id = 'good'), s AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE gain > 1e-6) AS wins, list_sort(list(gain))[CAST(floor(count(*) / 2.0) AS INTEGER) + 1] AS mid FROM u) SELECT g + 1e-6 >= 0.03 * bv AND pairs >= 3 AND wins >= 2 AND mid > 1e-6 AS confirmed, pairs, wins, round(mid, 4) AS middle_gain, CASE WHEN NOT (g + 1e-6 >= 0.03 * bv AND pairs >= 3 AND wins >= 2 AND mid > 1e-6) THEN 'GAIN_NOT_REPEATED_IN_CONFIRMATION' END AS reason FROM s, j")
def confirmation_decision(spark, sf):
    joint, units, base = _candidates(spark, sf)
    one = lambda c, n: units.where(F.col("candidate_id") == c).select("unit_id", F.col("value").alias(n))
    whole = lambda c, n: joint.where(F.col("candidate_id") == c).select(F.col("primary_value").alias(n))
    pairs = one("good", "candidate_value").join(one("base", "baseline_value"), "unit_id")
    total = whole("good", "candidate_value").join(whole("base", "baseline_value"), F.lit(True))
    return _rounded(selection.confirmation_gate(pairs, total, "mae", "min", 1e6))


ORACLE_DECISION, ORACLE_CONFIRMATION, ORACLE_HOLDOUT = (ORACLE_SQL[k] for k in ("selection_decision", "confirmation_decision", "holdout_counts"))
