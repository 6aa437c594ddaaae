"""Queries over the scalar functions. Dirty text is derived from clean columns by the same rules in both dialects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.functions import dates, hashing, numbers, text
from tallywright.operators import tables
from tallywright.plans.register import query, read


@query("str_trim", "SELECT c_custkey, trim(chr(9) || '  ' || c_name || '  ' || chr(10), ' ' || chr(9) || chr(10)) AS trimmed FROM customer")
def str_trim(spark, sf):
    raw = F.concat(F.lit("\t  "), "c_name", F.lit("  \n"))
    return read(spark, sf, "customer").select("c_custkey", text.trim_text(raw).alias("trimmed"))


@query("str_empty_to_null", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def str_empty_to_null(spark, sf):
    raw = F.when(F.col("c_custkey") % 10 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment"))
    return read(spark, sf, "customer").select("c_custkey", text.empty_to_null(raw).alias("segment"))


@query("category_merge", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSE' WHEN 'FURNITURE' THEN 'HOUSE' ELSE c_mktsegment END AS segment FROM customer")
def category_merge(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.merge_categories(F.col("c_mktsegment"), {"BUILDING": "HOUSE", "FURNITURE": "HOUSE"}).alias("segment"))


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _number_sql(bad: str, scale: str = "1.0") -> str:
    return f"SELECT o_orderkey, CASE WHEN {bad} THEN NULL ELSE round(({_CENTS} / 100.0) / {scale}, 6) END AS value, ({bad}) AS invalid FROM orders"


def _number(spark, sf, raw, bad, **how):
    """Cents as text with the marks asked for; every row where ``bad`` holds gets a letter."""
    orders = read(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    parsed = numbers.parse_number(F.when(bad, F.lit("12x4")).otherwise(raw), **how)
    return orders.select("o_orderkey", parsed.alias("p")).select("o_orderkey", F.round("p.value", 6).alias("value"), F.col("p.invalid").alias("invalid"))


def _grouped(mark: str, point: str):
    whole, rest = F.expr("cents div 100"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    return F.concat(F.when(whole >= 1000, F.concat((F.expr("cents div 100000")).cast("string"), F.lit(mark), F.lpad((whole % 1000).cast("string"), 3, "0"))).otherwise(whole.cast("string")), F.lit(point), rest)


@query("parse_number_comma", _number_sql("o_orderkey % 11 = 0"))
def parse_number_comma(spark, sf):
    return _number(spark, sf, F.concat(F.lit(" "), _grouped(".", ",")), F.col("o_orderkey") % 11 == 0, decimal=",", thousands=".")


@query("parse_number_dot", _number_sql("o_orderkey % 7 = 0"))
def parse_number_dot(spark, sf):
    return _number(spark, sf, _grouped(",", "."), F.col("o_orderkey") % 7 == 0, thousands=",")


@query("parse_number_percent", _number_sql("o_orderkey % 5 = 0", "100.0"))
def parse_number_percent(spark, sf):
    return _number(spark, sf, F.concat(_grouped(",", "."), F.lit(" %")), F.col("o_orderkey") % 5 == 0, thousands=",", percent=True)


@query("parse_number_currency", _number_sql("o_orderkey % 13 = 0"))
def parse_number_currency(spark, sf):
    return _number(spark, sf, F.concat(F.lit("S/ "), _grouped(",", ".")), F.col("o_orderkey") % 13 == 0, thousands=",", currency="PEN")


@query("mixed_currencies", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS pen, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS usd, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS eur FROM orders GROUP BY 1")
def mixed_currencies(spark, sf):
    raw = F.concat(F.element_at(F.array(F.lit("S/ "), F.lit("US$ "), F.lit("€ ")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.round("o_totalprice", 2).cast("string"))
    orders = read(spark, sf, "orders").select("o_orderpriority", raw.alias("raw"))
    return orders.groupBy("o_orderpriority").agg(*[F.count_if(numbers.has_currency(F.col("raw"), c)).alias(c.lower()) for c in ("PEN", "USD", "EUR")])


def _date(spark, sf, raw, order):
    parsed = dates.parse_date(raw, order)
    return read(spark, sf, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", F.col("p.value").alias("value"), F.col("p.invalid").alias("invalid"))


def _date_sql(bad: str) -> str:
    return f"SELECT o_orderkey, CASE WHEN {bad} THEN NULL ELSE CAST(o_orderdate AS DATE) END AS value, ({bad}) AS invalid FROM orders"


def _spelt(pattern: str):
    return F.date_format("o_orderdate", pattern)


@query("parse_date_dmy", _date_sql("o_orderkey % 9 = 0"))
def parse_date_dmy(spark, sf):
    return _date(spark, sf, F.when(F.col("o_orderkey") % 9 == 0, "31/02/2001").otherwise(_spelt("dd/MM/yyyy")), "DMY")


@query("parse_date_mdy", _date_sql("o_orderkey % 9 = 1"))
def parse_date_mdy(spark, sf):
    return _date(spark, sf, F.when(F.col("o_orderkey") % 9 == 1, "soon").otherwise(_spelt("M-d-yyyy")), "MDY")


@query("parse_date_ymd", _date_sql("o_orderkey % 9 = 2"))
def parse_date_ymd(spark, sf):
    return _date(spark, sf, F.when(F.col("o_orderkey") % 9 == 2, "2001-13-01").otherwise(_spelt("yyyy-MM-dd HH:mm:ss")), "YMD")


@query("parse_date_unambiguous", _date_sql("o_orderkey % 2 = 0 AND day(o_orderdate) <= 12"))
def parse_date_unambiguous(spark, sf):
    return _date(spark, sf, F.when(F.col("o_orderkey") % 2 == 0, _spelt("dd/MM/yyyy")).otherwise(_spelt("yyyy-MM-dd")), "UNAMBIGUOUS")


@query("serial_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS value FROM orders")
def serial_date(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")) + 0.75
    return read(spark, sf, "orders").select("o_orderkey", dates.serial_date(day).alias("value"))


@query("safe_example", "SELECT doc_id, substr(translate(text, chr(10) || chr(13), '  '), 1, 120) AS example FROM documents")
def safe_example(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.safe_example(F.col("text")).alias("example"))


@query("formula_safe", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN '''-' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS data_text, CASE WHEN c_custkey % 4 = 0 THEN '''=' || c_name WHEN c_custkey % 4 = 1 THEN '-' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS report_text FROM customer")
def formula_safe(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("-"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return read(spark, sf, "customer").select("c_custkey", text.formula_safe(raw).alias("data_text"), text.formula_safe(raw, keep_numbers=True).alias("report_text"))


@query("stable_seed", "SELECT c_custkey, CAST(('0x' || substr(sha256('42:' || c_name || ':fold'), 1, 8)) AS BIGINT) & 2147483647 AS seed FROM customer")
def stable_seed(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", hashing.stable_seed(F.lit(42), F.col("c_name"), F.lit("fold")).alias("seed"))


@query("row_blocks", "SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY 1, 2")
def row_blocks(spark, sf):
    block = hashing.row_block(F.col("o_orderstatus"), F.col("o_orderpriority"))
    return read(spark, sf, "orders").groupBy(block.alias("block")).agg(F.first("o_orderstatus").alias("o_orderstatus"), F.first("o_orderpriority").alias("o_orderpriority"), F.count(F.lit(1)).alias("rows")).drop("block")


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_LINE_TEXT = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in _LINE)


@query(
    "table_digest",
    f"WITH r AS (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax, * EXCLUDE (l_tax) FROM lineitem), h AS (SELECT sha256((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) || '|' || {_LINE_TEXT}) AS h FROM r) "
    "SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM h",
)
def table_digest(spark, sf):
    """Digest of order lines in the order of their keys, some taxes being null."""
    lines = read(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax"))).select(*_LINE)
    return hashing.table_digest(tables.numbered(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]), position="position")
