"""Queries over sources, tables and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.operators import profile, tables
from tallywright.operators import recipe as R
from tallywright.plans.register import query, read
from tallywright.sources import files
from tallywright.staging import shared_folder


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"]).where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}"


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def scan_csv(spark, sf):
    """Orders written with semicolons and read back by the dialect that inspection finds."""
    path = _folder(spark, "orders-csv")
    orders = read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    orders.write.csv(path, sep=";", header=True)
    sep = files.inspect_csv(spark, f"{path}/*.csv").groupBy("delimiter").count().orderBy(F.desc("count")).first()["delimiter"]
    return files.read_csv(spark, path, sep=sep, schema=orders.schema).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("scan_csv_quoted", "SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents WHERE doc_id IS NOT NULL")
def scan_csv_quoted(spark, sf):
    """Documents, whose texts hold quotes and line breaks, written as quoted cells and read by as many tasks as their files have splits."""
    path = _folder(spark, "documents-csv")
    read(spark, sf, "documents").select("doc_id", "lang", "text").write.option("escape", '"').csv(path, header=True)
    back = files.read_csv(spark, path, schema=T.StructType().add("doc_id", "long").add("lang", "string").add("text", "string"))
    return back.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


@query("inspect_files", "SELECT 'utf-8' AS encoding, '|' AS delimiter, CAST(sum(strlen(c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_mktsegment) + 1) AS BIGINT) AS size_bytes FROM customer")
def inspect_files(spark, sf):
    """Customers written with bars; what inspection says of the files, and their bytes together."""
    path = _folder(spark, "customers-csv")
    read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(path, sep="|")
    return files.inspect_csv(spark, f"{path}/*.csv").groupBy("encoding", "delimiter").agg(F.sum("size_bytes").alias("size_bytes"))


@query("table_shape", "SELECT 'lineitem' AS table_name, count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem UNION ALL SELECT 'orders', count(*), CAST(6 AS BIGINT) FROM orders")
def table_shape(spark, sf):
    return tables.union_roles(*[tables.table_shape(read(spark, sf, t)).withColumn("table_name", F.lit(t)) for t in ("lineitem", "orders")])


@query("column_mapping", "SELECT CAST(row_number() OVER (ORDER BY column_index) - 1 AS INTEGER) AS position, printf('c%04d', row_number() OVER (ORDER BY column_index)) AS column_id, column_name AS display_name, column_name AS source_name FROM duckdb_columns() WHERE table_name = 'orders' AND EXISTS (SELECT 1 FROM orders)")
def column_mapping(spark, sf):
    return tables.normalize_columns(read(spark, sf, "orders"))[1]


@query("preview_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def preview_page(spark, sf):
    return tables.page(read(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", "o_totalprice")


_BLANK = "c_custkey % 10 = 0"
_CUSTOMERS = f"SELECT c_custkey, CASE WHEN {_BLANK} THEN NULL ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(round(c_acctbal * 100) AS BIGINT) / 100.0 END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSE' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 17 = 0 AS bad FROM customer"


def _dirty(spark, sf):
    """Customers with padded or blank names, balances as comma text (some not numbers), and a day as text."""
    amount = F.concat(F.expr("cast(round(c_acctbal * 100) as bigint)").cast("decimal(20,0)").cast("string"), F.lit("e-2"))
    return read(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("\t"))).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_custkey") % 17 == 0, "n/a").otherwise(amount).alias("c_acctbal"),
        "c_mktsegment",
    )


_RECIPE = R.Recipe(
    columns=(
        R.ColumnRule("c_name", "text", "identifier", trim=True, empty_to_null=True),
        R.ColumnRule("c_acctbal", "numeric", invalid="segregate"),
        R.ColumnRule("c_mktsegment", "category", merges={"BUILDING": "HOUSE"}),
    ),
    filters=(R.NumericNotNull("c_acctbal"), R.Category("c_mktsegment", "exclude", ("MACHINERY",))),
)


@query("apply_recipe", f"SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM ({_CUSTOMERS}) WHERE NOT bad AND c_mktsegment <> 'MACHINERY'")
def apply_recipe(spark, sf):
    return R.apply_recipe(_dirty(spark, sf), _RECIPE, "c_custkey").data.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("quarantine", f"SELECT c_custkey AS row_id, CASE WHEN bad THEN 'UNCONVERTIBLE_VALUE' ELSE 'FILTERED_OUT' END AS reason, CASE WHEN bad THEN 'c_acctbal' ELSE 'c_mktsegment' END AS column_id, CASE WHEN bad THEN 'n/a' ELSE c_mktsegment END AS original_value, CASE WHEN bad THEN 'conversion' ELSE 'filters' END AS stage FROM ({_CUSTOMERS}) WHERE bad OR c_mktsegment = 'MACHINERY'")
def quarantine(spark, sf):
    return R.apply_recipe(_dirty(spark, sf), _RECIPE, "c_custkey").quarantine


@query("invalid_counts", 'SELECT \'c_name\' AS "column", CAST(0 AS BIGINT) AS invalid UNION ALL SELECT \'c_acctbal\', count(*) FILTER (WHERE c_custkey % 17 = 0) FROM customer UNION ALL SELECT \'c_mktsegment\', CAST(0 AS BIGINT)')
def invalid_counts(spark, sf):
    return R.blocked_values(_dirty(spark, sf), _RECIPE)


@query(
    "transformation_log",
    f"SELECT CAST(1 AS INTEGER) AS step, 'c_name' AS column_id, 'column' AS description, count(*) AS affected, CAST(0 AS BIGINT) AS invalid, 'string' AS type_before, 'string' AS type_after FROM customer "
    f"UNION ALL SELECT 2, 'c_acctbal', 'column', count(*), count(*) FILTER (WHERE bad), 'string', 'double' FROM ({_CUSTOMERS}) "
    f"UNION ALL SELECT 3, 'c_mktsegment', 'column', count(*) FILTER (WHERE c_mktsegment = 'HOUSE'), 0, 'string', 'string' FROM ({_CUSTOMERS}) "
    f"UNION ALL SELECT 5, 'c_acctbal', 'filter NumericNotNull', 0, 0, NULL, NULL "
    f"UNION ALL SELECT 6, 'c_mktsegment', 'filter Category', count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' AND NOT bad), 0, NULL, NULL FROM ({_CUSTOMERS})",
)
def transformation_log(spark, sf):
    return R.apply_recipe(_dirty(spark, sf), _RECIPE, "c_custkey").log


@query("change_preview", "SELECT CAST(4 AS INTEGER) AS position, c_custkey AS row_id, 'c_mktsegment' AS column_id, 'BUILDING' AS before, 'HOUSE' AS after FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30")
def change_preview(spark, sf):
    only = R.Recipe(columns=(_RECIPE.columns[2],))
    return R.preview_changes(R.apply_recipe(_dirty(spark, sf), only, "c_custkey"))


@query("filter_date_range", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'")
def filter_date_range(spark, sf):
    return read(spark, sf, "orders").where(R.DateRange("o_orderdate", "1996-02-01", "1997-01-31").keeps()).select("o_orderkey")


@query("filter_category", "SELECT o_orderkey, 'exclude' AS mode FROM orders WHERE o_orderkey % 10 = 0 OR o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'include' FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus IN ('F', 'O')")
def filter_category(spark, sf):
    orders = read(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))
    return tables.union_roles(*[orders.where(R.Category("status", m, ("F", "O")).keeps()).select("o_orderkey", F.lit(m).alias("mode")) for m in ("exclude", "include")])


@query("filter_numeric_not_null", "SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0")
def filter_numeric_not_null(spark, sf):
    return _dirty(spark, sf).where(R.NumericNotNull("c_acctbal").keeps()).select("c_custkey")


@query("dedupe_exact", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def dedupe_exact(spark, sf):
    return R.dedupe_exact(read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")[0]


@query("prepared_dictionary", "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'c_custkey', 'number', 'identifier', 'names a row; never a feature'), (1, 'c_name', 'category or text', 'variable', 'may be used as a feature'), (2, 'c_nationkey', 'number', 'variable', 'may be used as a feature'), (3, 'c_acctbal', 'number', 'variable', 'may be used as a feature'), (4, 'c_mktsegment', 'category or text', 'variable', 'may be used as a feature')) t(position, column_name, kind, role, meaning) WHERE EXISTS (SELECT 1 FROM customer)")
def prepared_dictionary(spark, sf):
    return tables.dictionary(R.apply_recipe(_dirty(spark, sf), _RECIPE, "c_custkey").data, {"c_custkey": "identifier"})


@query("lineage_counts", f"SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT bad AND c_mktsegment <> 'MACHINERY') AS rows_out, count(*) FILTER (WHERE bad OR c_mktsegment = 'MACHINERY') AS rows_quarantined FROM ({_CUSTOMERS})")
def lineage_counts(spark, sf):
    dirty = _dirty(spark, sf)
    done = R.apply_recipe(dirty, _RECIPE, "c_custkey")
    return tables.lineage(dirty, done.data, done.quarantine, _RECIPE.digest(), with_digests=False).drop("recipe_digest")


@query("share_projection", "SELECT 'fold-' || CAST(o_orderkey % 5 AS VARCHAR) AS unit_id, 'validation' AS part, count(*) AS rows FROM orders GROUP BY 1, 2")
def share_projection(spark, sf):
    splits = read(spark, sf, "orders").groupBy(F.concat(F.lit("fold-"), (F.col("o_orderkey") % 5).cast("string")).alias("unit_id"), F.lit("validation").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("row_id"))
    return tables.share_projection({"splits": splits})["splits"]


@query("stride_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) WHERE rn % CAST(ceil(n / 400.0) AS BIGINT) = 0 ORDER BY rn LIMIT 400")
def stride_sample(spark, sf):
    return tables.stride_sample(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 400)


@query("even_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE rn IN (SELECT CAST(floor(i * (SELECT max(n) - 1 FROM r) / 499) AS BIGINT) FROM range(500) t(i))")
def even_sample(spark, sf):
    return tables.even_sample(read(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 500)


@query("write_prepared", "SELECT 'data' AS table_name, count(*) AS rows FROM (" + _CUSTOMERS + ") WHERE NOT bad AND c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'quarantine', count(*) FROM (" + _CUSTOMERS + ") WHERE bad OR c_mktsegment = 'MACHINERY' UNION ALL SELECT 'transformations', 5 FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM customer)) UNION ALL SELECT 'quality', 2 FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM customer)) UNION ALL SELECT 'dictionary', 5 FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM customer))")
def write_prepared(spark, sf):
    """The prepared customers written as tables and counted as they are read back."""
    dirty = _dirty(spark, sf)
    done = R.apply_recipe(dirty, _RECIPE, "c_custkey")
    path = _folder(spark, "prepared")
    files.write_prepared(done, tables.dictionary(done.data), profile.quality_comparison(dirty, done.data), path)
    names = ("data", "quarantine", "transformations", "quality", "dictionary")
    return tables.union_roles(*[spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n)) for n in names])
