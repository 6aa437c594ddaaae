"""Queries over profiles and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.operators import profile as P
from tallywright.operators import tables, temporal
from tallywright.plans.register import query, read


@query("table_profile", "SELECT count(*) AS row_count, CAST(2 AS BIGINT) AS column_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)) AS duplicate_rows FROM orders")
def table_profile(spark, sf):
    return P.table_profile(read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


def _customer(spark, sf):
    return read(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))).withColumn("constant", F.lit("x"))


_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_id, CAST({k} AS INTEGER) AS position, '{t}' AS semantic_type, 'variable' AS role, count({x}) AS non_null, count(*) - count({x}) AS null_count, count(DISTINCT {x}) AS distinct_count, {p} AS possible_id, CASE WHEN count({x}) < count(*) THEN 'MISSING_VALUES,' ELSE '' END || CASE WHEN count(DISTINCT {x}) <= 1 THEN 'CONSTANT_OR_EMPTY,' ELSE '' END || CASE WHEN {p} THEN 'POSSIBLE_IDENTIFIER,' ELSE '' END AS issues FROM customer"
    for k, (c, x, t, p) in enumerate([("c_custkey", "c_custkey", "numeric", "false"), ("c_name", "c_name", "categorical", "true"), ("c_nationkey", "c_nationkey", "numeric", "false"), ("c_acctbal", "c_acctbal", "numeric", "false"), ("c_mktsegment", "CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END", "categorical", "false"), ("constant", "'x'", "categorical", "false")])
)


@query("column_profile", _PROFILE)
def column_profile(spark, sf):
    issues = F.concat(F.array_join("issues", ","), F.when(F.size("issues") > 0, ",").otherwise(""))
    return P.column_profile(_customer(spark, sf)).withColumn("issues", issues)


@query("column_examples", "SELECT 'c_mktsegment' AS column_id, c_custkey AS at, c_mktsegment AS example FROM customer WHERE c_custkey % 10 <> 0 ORDER BY c_custkey LIMIT 4")
def column_examples(spark, sf):
    return P.examples(_customer(spark, sf), "c_mktsegment", "c_custkey")


@query("semantic_types", "SELECT * FROM (VALUES ('o_orderkey', CAST(0 AS INTEGER), 'numeric'), ('o_orderdate', 1, 'datetime'), ('day_text', 2, 'datetime'), ('o_orderpriority', 3, 'categorical')) t(column_id, position, semantic_type) WHERE EXISTS (SELECT 1 FROM orders)")
def semantic_types(spark, sf):
    day = F.when(F.col("o_orderkey") % 50 == 0, "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return P.semantic_types(read(spark, sf, "orders").select("o_orderkey", "o_orderdate", day.alias("day_text"), "o_orderpriority"))


@query("possible_ids", "SELECT 'event_id' AS column_id, (SELECT count(*) >= 10 AND count(DISTINCT event_id) >= 0.98 * count(event_id) FROM events) AS possible_id UNION ALL SELECT 'user_id', (SELECT count(*) >= 10 AND count(DISTINCT user_id) >= 0.98 * count(user_id) FROM events)")
def possible_ids(spark, sf):
    return P.column_profile(read(spark, sf, "events").select("event_id", "user_id")).select("column_id", "possible_id")


@query("quality_comparison", "SELECT 'before' AS version, count(*) AS row_count, CAST(2 AS BIGINT) AS numeric_columns, CAST(0 AS BIGINT) AS date_columns, count(*) FILTER (WHERE c_custkey % 10 = 0) AS missing_cells, CAST(0 AS BIGINT) AS duplicate_rows FROM customer UNION ALL SELECT 'after', count(*), 2, 0, 0, 0 FROM customer WHERE c_custkey % 10 <> 0")
def quality_comparison(spark, sf):
    before = _customer(spark, sf).select("c_custkey", "c_acctbal", "c_mktsegment")
    return P.quality_comparison(before, before.where(F.col("c_mktsegment").isNotNull()))


_BOX = "WITH q AS (SELECT quantile_cont({c}, CAST(0.25 AS DOUBLE)) a, quantile_cont({c}, CAST(0.5 AS DOUBLE)) m, quantile_cont({c}, CAST(0.75 AS DOUBLE)) b FROM lineitem) SELECT '{c}' AS column_id, count(*) AS n, round(any_value(a), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(b), 4) AS q3, round(min({c}) FILTER (WHERE {c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)), 4) AS low_whisker, round(max({c}) FILTER (WHERE {c} >= a - 1.5 * (b - a) AND {c} <= b + 1.5 * (b - a)), 4) AS high_whisker, count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM lineitem, q"


@query("boxplots", " UNION ALL ".join(f"SELECT * FROM ({_BOX.format(c=c)})" for c in ("l_quantity", "l_extendedprice")))
def boxplots(spark, sf):
    out = P.boxplots(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUMS) for b in _NUMS[i + 1 :])


@query("correlations", _CORR)
def correlations(spark, sf):
    return P.correlations(read(spark, sf, "lineitem"), _NUMS).withColumn("r", F.round("r", 6))


@query("top_pairs", f'SELECT * FROM ({_CORR}) ORDER BY abs(r) DESC, "left" DESC, "right" DESC LIMIT 3')
def top_pairs(spark, sf):
    return P.top_pairs(correlations(spark, sf))


def _amounts(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.expr("cast(round(o_totalprice * 100) as bigint) div 100")
    return read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S/ "), F.format_number(whole, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")).alias("amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), "o_orderpriority", F.concat(F.lit(" "), "o_orderstatus").alias("status"))


@query("numeric_pattern", "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS share, false AS percent, '.' AS decimal_mark, ',' AS thousands_mark, 'PEN' AS currency, false AS mixed FROM orders")
def numeric_pattern(spark, sf):
    return P.numeric_pattern(_amounts(spark, sf), "amount")


@query("date_pattern", "SELECT count(*) AS n, CAST(1 AS DOUBLE) AS share, bool_or(day(o_orderdate) <= 12) AS ambiguous, CASE WHEN NOT bool_or(day(o_orderdate) <= 12) THEN 'DMY' END AS recommended FROM orders")
def date_pattern(spark, sf):
    return P.date_pattern(_amounts(spark, sf), "day")


@query("suggestions", "SELECT * FROM (VALUES ('o_orderkey', 'numeric', 'variable', false, false, NULL), ('amount', 'numeric', 'identifier', false, false, 'NUMBER_STORED_AS_TEXT'), ('day', 'date', 'variable', false, false, 'AMBIGUOUS_DATE'), ('o_orderpriority', 'category', 'variable', false, false, NULL), ('status', 'category', 'variable', true, false, NULL)) t(column_id, type, role, \"trim\", empty_to_null, alert) WHERE EXISTS (SELECT 1 FROM orders)")
def suggestions(spark, sf):
    return P.suggest_preparation(_amounts(spark, sf))


@query("feature_resolution", "SELECT * FROM (VALUES ('c_custkey', 'ROLE'), ('c_name', 'EXCLUDED'), ('c_nationkey', NULL), ('c_acctbal', 'TARGET'), ('c_mktsegment', NULL), ('constant', NULL)) t(column_id, reason) WHERE EXISTS (SELECT 1 FROM customer)")
def feature_resolution(spark, sf):
    return P.resolve_features(P.column_profile(_customer(spark, sf), {"c_custkey": "identifier"}), "c_acctbal", exclude=["c_name"])


@query("scenario_controls", "SELECT 'p_retailprice' AS column_id, 'numeric' AS kind, round(quantile_cont(p_retailprice, CAST(0.01 AS DOUBLE)), 4) AS low, round(quantile_cont(p_retailprice, CAST(0.99 AS DOUBLE)), 4) AS high, round(median(p_retailprice), 4) AS middle, round((quantile_cont(p_retailprice, CAST(0.99 AS DOUBLE)) - quantile_cont(p_retailprice, CAST(0.01 AS DOUBLE))) / 100, 4) AS step, CAST(NULL AS VARCHAR) AS option, CAST(NULL AS INTEGER) AS rank, false AS truncated FROM part UNION ALL SELECT 'p_brand', 'category', NULL, NULL, NULL, NULL, p_brand, CAST(rk AS INTEGER), n > 20 FROM (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk, count(*) OVER () AS n FROM part GROUP BY p_brand) WHERE rk <= 20")
def scenario_controls(spark, sf):
    out = P.scenario_controls(read(spark, sf, "part"), ["p_retailprice"], ["p_brand"])
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _monthly(spark, sf, how):
    return temporal.monthly(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", how, ["o_orderpriority"]).withColumn("value", F.round("value", 2))


_MONTHLY = "SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round({}(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2"


@query("monthly_sum", _MONTHLY.format("sum"))
def monthly_sum(spark, sf):
    return _monthly(spark, sf, "sum")


@query("monthly_mean", _MONTHLY.format("avg"))
def monthly_mean(spark, sf):
    return _monthly(spark, sf, "mean")


@query("missing_months", f"WITH o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), b AS (SELECT o_custkey, min(m) a, max(m) z FROM o GROUP BY 1), c AS (SELECT o_custkey, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS month FROM b) SELECT c.o_custkey, c.month FROM c ANTI JOIN o ON c.o_custkey = o.o_custkey AND c.month = o.m")
def missing_months(spark, sf):
    return temporal.missing_months(read(spark, sf, "orders"), "o_orderdate", ["o_custkey"])


@query("temporal_check", "WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT o_custkey, d, d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS gap FROM d), m AS (SELECT o_custkey, date_trunc('month', d) AS mm, count(*) AS n FROM d GROUP BY 1, 2), ms AS (SELECT o_custkey, count(*) AS observed, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rep, min(mm) AS a, max(mm) AS b FROM m GROUP BY 1), gs AS (SELECT o_custkey, min(d) AS first_date, max(d) AS last_date, median(gap) AS mg FROM g GROUP BY 1) SELECT o_custkey, first_date, last_date, CASE WHEN mg <= 2 THEN 'daily' WHEN rep = 0 THEN 'monthly' ELSE 'several_per_month' END AS frequency, observed AS observed_months, datediff('month', a, b) + 1 - observed AS missing_months, rep AS rows_in_repeated_months, CAST(0 AS BIGINT) AS invalid_dates FROM gs JOIN ms USING (o_custkey)")
def temporal_check(spark, sf):
    return temporal.temporal_check(read(spark, sf, "orders"), "o_orderdate", ["o_custkey"])


@query("month_index", "SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate)) - 1 AS INTEGER) AS t FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)")
def month_index(spark, sf):
    series = temporal.monthly(read(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", ["o_orderpriority"])
    return temporal.month_index(series, ["o_orderpriority"]).drop("value")


@query("top_pair_points", """WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL) SELECT 'o_custkey' AS "left", 'o_totalprice' AS "right", o_orderkey AS row_id, CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM r WHERE rn IN (SELECT CAST(floor(i * (SELECT max(n) - 1 FROM r) / 499) AS BIGINT) FROM range(500) t(i))""")
def top_pair_points(spark, sf):
    orders = read(spark, sf, "orders")
    return P.pair_points(orders, P.top_pairs(P.correlations(orders, ["o_custkey", "o_totalprice"])), "o_orderkey")


@query("display_names", "SELECT column_id, CASE column_id WHEN 'c0001' THEN 'o_orderkey' WHEN 'c0004' THEN 'o_totalprice' ELSE column_id END AS display_name, n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'c0001' WHEN 1 THEN 'c0004' ELSE 'unknown' END AS column_id, count(*) AS n FROM orders GROUP BY 1)")
def display_names(spark, sf):
    orders = read(spark, sf, "orders")
    ids = F.when(F.col("o_orderkey") % 3 == 0, "c0001").when(F.col("o_orderkey") % 3 == 1, "c0004").otherwise("unknown")
    return tables.with_names(orders.groupBy(ids.alias("column_id")).agg(F.count(F.lit(1)).alias("n")), tables.normalize_columns(orders)[1])
