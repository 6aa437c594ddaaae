"""Tables as a whole: shape, width, headers, pages, samples, unions, dictionaries, lineage, and shared projections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import table_digest
from tallywright.staging import materialize

ROWS_PER_PART, MOST_ROWS_PER_PART = 25_000, 500_000  # rows that a task of costly work reads at least, at most


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))


def check_width(df: DataFrame, most: int = 300) -> None:
    if len(df.columns) > most:
        raise ValueError(f"TOO_MANY_COLUMNS: {len(df.columns)} > {most}")
    if df.columns and all(c.startswith("Unnamed:") or not c.strip() for c in df.columns):
        raise ValueError("HEADER_MISSING")


def column_mapping(headers: list[str]) -> list[tuple[int, str, str, str]]:
    """(position, column_id, display_name, source_name): white space collapsed, 200 characters at most, repeats numbered."""
    out, seen = [], {}
    for k, source in enumerate(headers):
        name = re.sub(r"\s+", " ", source or "").strip()[:200] or f"Column {k + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append((k, f"c{k + 1:04d}", name if seen[name] == 1 else f"{name} ({seen[name]})", source))
    return out


def normalize_columns(df: DataFrame, headers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    rows = column_mapping(headers or df.columns)
    return df.toDF(*[r[1] for r in rows]), df.sparkSession.createDataFrame(rows, "position int, column_id string, display_name string, source_name string")


def page(df: DataFrame, order_by: list[str], number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) in the order given: a view of fixed size."""
    return df.orderBy(*order_by).offset(size * (number - 1)).limit(size)


def numbered(df: DataFrame, order_by: list[str], name: str = "position", drop: Sequence[str] = ()) -> DataFrame:
    """Positions 0, 1, ... in a global order: rows are range-partitioned and sorted, and each partition starts after the rows of those
    before it. No task sees more than its range. Columns to ``drop`` order the rows without being written."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by).withColumn("__p", F.spark_partition_id())
    local = ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = materialize(local.drop(*drop), "numbered")  # what is counted must be what is numbered, even if an executor is lost in between
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("__start", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return local.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__at")).drop("__p", "__at", "__start")


def stride_sample(df: DataFrame, order_by: list[str], limit: int, n: int | None = None) -> DataFrame:
    """Rows 0, step, 2 step, ... with step = ceil(n / limit), ``limit`` at most."""
    n = df.count() if n is None else n
    if n <= limit:
        return df
    step = -(-n // limit)
    return numbered(df, order_by).where((F.col("position") % step == 0) & (F.col("position") < step * limit)).drop("position")


def even_sample(df: DataFrame, order_by: list[str], m: int, n: int | None = None) -> DataFrame:
    """m rows at positions floor(i (n - 1) / (m - 1))."""
    n = df.count() if n is None else n
    if n <= m:
        return df
    grid = df.sparkSession.range(m).select(F.floor(F.col("id") * F.lit(n - 1) / F.lit(max(1, m - 1))).alias("position"))
    return numbered(df, order_by).join(grid, "position", "left_semi").drop("position")


def union_roles(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def human_type(kind: str) -> str:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return "date"
    return "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else "category or text"


def even_parts(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n``) in parts for costly work: as many as there are cores, or it would run on a few of them only, and no more, as in a fit
    each part counts all nodes of all trees; fewer where parts would be tiny, more where they would be large."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(-(-n // ROWS_PER_PART), max(cores, -(-n // MOST_ROWS_PER_PART)))))


# fixed values: what each role means to a reader
ROLE_TEXT = {"variable": "may be used as a feature", "identifier": "names a row; never a feature", "ignore": "left out of the analysis"}


def dictionary(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    roles = roles or {}
    rows = [(k, c, human_type(t), roles.get(c, "variable"), ROLE_TEXT[roles.get(c, "variable")]) for k, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, kind string, role string, meaning string")


def lineage(before: DataFrame, after: DataFrame, quarantine: DataFrame, recipe_digest: str, with_digests: bool = True) -> DataFrame:
    """One row: rows in, out and quarantined (distinct row ids), and the recipe's and both tables' digests."""
    counts = [before.agg(F.count(F.lit(1)).alias("rows_in")), after.agg(F.count(F.lit(1)).alias("rows_out")), quarantine.agg(F.count_distinct("row_id").alias("rows_quarantined"))]
    if with_digests:
        counts += [table_digest(before).select(F.col("digest").alias("input_digest")), table_digest(after).select(F.col("digest").alias("output_digest"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, F.lit(True))  # one row each
    return out.withColumn("recipe_digest", F.lit(recipe_digest))


# fixed values: what may leave with a shared result, by table
SHARED_FIELDS = {
    "candidates": ("candidate_id", "primary_value", "complexity", "status", "reason", "baseline_id", "joint_gain", "pairs", "wins", "median_gain"),
    "unit_metrics": ("candidate_id", "unit_id", "value"),
    "splits": ("unit_id", "part", "rows"),
    "columns": ("position", "column_name", "kind"),
    "decision": ("selected_id", "best_observed_id", "baseline_id", "passing"),
    "confirmation": ("confirmed", "pairs", "wins", "middle_gain", "reason"),
    "plan": ("plan_version", "plan_sha256", "primary_metric", "metric_direction", "population_count", "validation_strategy", "evaluation_unit_count"),
}
SUMMARY_FIELDS = ("candidate_id", "primary_value", "status", "reason")  # of a candidate


def share_projection(tables: dict[str, DataFrame], level: int = 1, detail: str = "full") -> dict[str, DataFrame]:
    """Allow-listed fields only; column names from level 2 on; ``summary`` keeps SUMMARY_FIELDS of a candidate. Never rows or cells."""
    out = {}
    for name, df in tables.items():
        allowed = [c for c in SHARED_FIELDS.get(name, ()) if c in df.columns]
        if name == "columns" and level < 2:
            allowed = [c for c in allowed if c != "column_name"]
        if name == "candidates" and detail == "summary":
            allowed = [c for c in allowed if c in SUMMARY_FIELDS]
        if allowed:
            out[name] = df.select(*allowed)
    return out


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def with_names(df: DataFrame, mapping: DataFrame, id_column: str = "column_id", out: str = "display_name") -> DataFrame:
    """``df`` with the display name of each column id (``mapping``: column_id, display_name); an unknown id stands for itself."""
    names = mapping.select(F.col("column_id").alias("__id"), F.col("display_name").alias("__name"))
    return df.join(names, F.col(id_column) == F.col("__id"), "left").withColumn(out, F.coalesce("__name", id_column)).drop("__id", "__name")
