"""Declarative cleaning: a recipe compiles to column expressions; rejected rows go to a quarantine table with a reason.

Order of work: per column trim → blanks to null → category merges → type conversion → invalid handling; then exact duplicates, filters
in order, and an optional monthly aggregation. Rows are converted once, into a table that all results are read from, and the checks of
``invalid="block"`` run on it; nothing else runs until a result is read.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import dates, numbers
from tallywright.functions.hashing import canonical_hash, row_mark
from tallywright.functions.text import empty_to_null, merge_categories, to_text, trim_text
from tallywright.operators.tables import even_parts
from tallywright.staging import materialize

DATE_ORDERS = ("DMY", "MDY", "YMD", "UNAMBIGUOUS", "SERIAL")


@dataclass(frozen=True)
class ColumnRule:
    column: str
    type: str = "keep"  # keep, text, category, numeric, date
    role: str = "variable"  # variable, identifier, ignore
    trim: bool = False
    empty_to_null: bool = False
    merges: dict[str, str] = field(default_factory=dict)
    date_order: str | None = None
    decimal: str = "."
    thousands: str | None = None
    percent: bool = False
    currency: str | None = None
    invalid: str = "block"  # block, segregate

    def __post_init__(self) -> None:
        if self.type not in ("keep", "text", "category", "numeric", "date") or self.role not in ("variable", "identifier", "ignore") or self.invalid not in ("block", "segregate"):
            raise ValueError(f"UNKNOWN_OPTION for {self.column}")
        if (self.type == "date") != (self.date_order is not None):
            raise ValueError(f"DATE_OPTIONS_NEED_DATE_TYPE for {self.column}")
        if self.date_order and self.date_order not in DATE_ORDERS:
            raise ValueError(f"UNKNOWN_DATE_ORDER for {self.column}")
        if self.type != "numeric" and (self.percent or self.currency or self.thousands or self.decimal != "."):
            raise ValueError(f"NUMERIC_OPTIONS_NEED_NUMERIC_TYPE for {self.column}")
        if self.decimal == self.thousands:
            raise ValueError(f"SAME_DECIMAL_AND_THOUSANDS for {self.column}")
        if self.merges and self.type not in ("keep", "text", "category"):
            raise ValueError(f"MERGES_NEED_TEXT for {self.column}")
        if len(self.merges) > 100:
            raise ValueError(f"TOO_MANY_MERGES for {self.column}")


@dataclass(frozen=True)
class DateRange:
    column: str
    start: str | None = None
    end: str | None = None

    def __post_init__(self) -> None:
        if self.start is None and self.end is None:
            raise ValueError("DATE_RANGE_NEEDS_A_BOUND")

    def keeps(self) -> Column:
        d = F.col(self.column).try_cast("date")
        bounds = [d.isNotNull(), *([d >= F.lit(self.start).cast("date")] if self.start else []), *([d <= F.lit(self.end).cast("date")] if self.end else [])]
        out = bounds[0]
        for b in bounds[1:]:
            out = out & b
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Category:
    column: str
    mode: str
    values: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.mode not in ("include", "exclude") or not 1 <= len(self.values) <= 100:
            raise ValueError("CATEGORY_FILTER_OPTIONS")

    def keeps(self) -> Column:
        among = F.coalesce(to_text(F.col(self.column)).isin(*self.values), F.lit(False))
        return among if self.mode == "include" else ~among


@dataclass(frozen=True)
class NumericNotNull:
    column: str

    def keeps(self) -> Column:
        return numbers.as_number(F.col(self.column)).isNotNull()


@dataclass(frozen=True)
class Recipe:
    columns: tuple[ColumnRule, ...] = ()
    drop_duplicates: bool = False
    filters: tuple = ()
    monthly: tuple[str, str, str] | None = None  # date column, value column, sum or mean
    expected_columns: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if len(self.columns) > 500 or len(self.filters) > 20:
            raise ValueError("RECIPE_TOO_LARGE")
        if len({c.column for c in self.columns}) != len(self.columns):
            raise ValueError("REPEATED_COLUMN")

    def digest(self) -> str:
        return canonical_hash(asdict(self))


@dataclass
class Prepared:
    data: DataFrame
    quarantine: DataFrame
    log: DataFrame
    changes: DataFrame
    before: DataFrame


def check_compatible(df: DataFrame, recipe: Recipe) -> None:
    used = {c.column for c in recipe.columns} | {f.column for f in recipe.filters} | set(recipe.expected_columns or ()) | set((recipe.monthly or ())[:2])
    missing = sorted(used - set(df.columns))
    if missing:
        raise ValueError(f"INCOMPATIBLE_RECIPE_COLUMNS: {missing}")


def converted(rule: ColumnRule) -> tuple[Column, Column]:
    """(value, invalid) of one column."""
    c = F.col(f"`{rule.column}`")
    cleaned = c
    if rule.trim:
        cleaned = trim_text(cleaned)
    if rule.empty_to_null:
        cleaned = empty_to_null(cleaned)
    if rule.merges:
        cleaned = merge_categories(cleaned, rule.merges)
    if rule.type == "numeric":
        s = numbers.parse_number(cleaned, rule.decimal, rule.thousands, rule.percent, rule.currency)
        return s["value"], s["invalid"]
    if rule.type == "date" and rule.date_order == "SERIAL":
        v = dates.serial_date(cleaned)
        return v, cleaned.isNotNull() & v.isNull()
    if rule.type == "date":
        s = dates.parse_date(cleaned, rule.date_order)
        return s["value"], s["invalid"]
    if rule.type in ("text", "category"):
        cleaned = to_text(cleaned)
    return cleaned, F.lit(False)


def compile_rows(df: DataFrame, recipe: Recipe) -> DataFrame:
    """One projection: every column converted, its original kept as ``before_<c>`` where a rule touches it, ``invalid_<c>`` marks, and
    ``reason``/``bad_column`` for the first failing rule that segregates. No state across rows, so streams use it as it is."""
    check_compatible(df, recipe)
    rules = {r.column: r for r in recipe.columns}
    pairs = {c: converted(r) for c, r in rules.items()}
    out = df.select(*[(pairs[c][0] if c in pairs else F.col(f"`{c}`")).alias(c) for c in df.columns], *[F.col(f"`{c}`").alias(f"before_{c}") for c in rules], *[pairs[c][1].alias(f"invalid_{c}") for c in rules])
    first = F.coalesce(*[F.when(F.col(f"invalid_{c}"), F.lit(c)) for c, r in rules.items() if r.invalid == "segregate"], F.lit(None).cast("string"))
    return out.withColumn("bad_column", first)


def blocked_values(df: DataFrame, recipe: Recipe) -> DataFrame:
    """column, invalid: how many values of each typed column fail, among rows that no earlier column has quarantined."""
    return _blocked(compile_rows(df, recipe), recipe)


def _blocked(rows: DataFrame, recipe: Recipe) -> DataFrame:
    done, found = F.lit(False), []
    for r in recipe.columns:
        bad = F.col(f"invalid_{r.column}")
        found.append(F.count_if(bad & ~done).alias(r.column))
        if r.invalid == "segregate":
            done = done | bad
    if not found:
        return rows.sparkSession.createDataFrame([], "column string, invalid long")
    wide = rows.agg(*found)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(r.column).alias("column"), F.col(f"`{r.column}`").alias("invalid")) for r in recipe.columns])).alias("x")).select("x.*")


def exact_duplicates(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """``df`` with ``is_copy``: a row after the first, by row id, of its group of equal rows (nulls are equal). Row ids are unique. Groups
    are told by a hash that each task counts first; only groups of two or more meet their rows again."""
    marked = df.withColumn("__mark", row_mark(*[F.col(f"`{c}`") for c in columns]))
    groups = marked.groupBy("__mark").agg(F.min(row_id).alias("__first"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    joined = marked.join(groups, "__mark", "left")
    return joined.withColumn("is_copy", F.coalesce(F.col(row_id) > F.col("__first"), F.lit(False))).drop("__mark", "__first", "__n")


def dedupe_exact(df: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    marked = exact_duplicates(df, [c for c in df.columns if c != row_id], row_id)
    return marked.where(~F.col("is_copy")).drop("is_copy"), marked.where("is_copy").drop("is_copy")


def apply_recipe(df: DataFrame, recipe: Recipe, row_id: str) -> Prepared:
    """Apply a recipe. Duplicates are judged on all converted rows, then taken from the active ones: a copy goes even if the first of its
    group sits in quarantine for another reason. Converting a cell costs far more than reading it, and all outputs need all cells: rows are
    spread over the cores, converted once and written as a table."""
    check_compatible(df, recipe)
    rows = materialize(compile_rows(even_parts(df, df.count()), recipe), "converted")
    blocking = [r for r in recipe.columns if r.invalid == "block" and r.type in ("numeric", "date")]
    if blocking:
        counts = {r["column"]: r["invalid"] for r in _blocked(rows, recipe).collect()}  # a row per column
        for r in blocking:
            if counts[r.column]:
                shown = rows.where(F.col(f"invalid_{r.column}")).select(F.col(f"before_{r.column}").cast("string")).limit(3).collect()
                raise ValueError(f"UNCONVERTIBLE_VALUES in {r.column}: {counts[r.column]}, such as {[x[0] for x in shown]}")
    names = [c for c in df.columns if c != row_id]
    if recipe.drop_duplicates:
        rows = exact_duplicates(rows, names, row_id)
    else:
        rows = rows.withColumn("is_copy", F.lit(False))
    stage = F.when(F.col("bad_column").isNotNull(), F.lit("conversion")).when(F.col("is_copy"), F.lit("duplicates"))
    failed = F.coalesce(*[F.when(~f.keeps(), F.lit(k)) for k, f in enumerate(recipe.filters)], F.lit(None).cast("int"))
    rows = rows.withColumn("filter_no", failed).withColumn("stage", F.coalesce(stage, F.when(F.col("filter_no").isNotNull(), F.lit("filters"))))
    original = F.coalesce(*[F.when(F.col("bad_column") == c.column, F.col(f"before_{c.column}").cast("string")) for c in recipe.columns], F.lit(None).cast("string"))
    filter_column = F.coalesce(*[F.when(F.col("filter_no") == k, F.lit(f.column)) for k, f in enumerate(recipe.filters)], F.lit(None).cast("string"))
    filter_value = F.coalesce(*[F.when(F.col("filter_no") == k, F.col(f"`{f.column}`").cast("string")) for k, f in enumerate(recipe.filters)], F.lit(None).cast("string"))
    is_stage = lambda s: F.col("stage") == s
    quarantine = rows.where(F.col("stage").isNotNull()).select(
        F.col(row_id).alias("row_id"),
        F.when(is_stage("conversion"), F.lit("UNCONVERTIBLE_VALUE")).when(is_stage("duplicates"), F.lit("EXACT_DUPLICATE")).otherwise(F.lit("FILTERED_OUT")).alias("reason"),
        F.when(is_stage("conversion"), F.col("bad_column")).when(is_stage("filters"), filter_column).alias("column_id"),
        F.when(is_stage("conversion"), original).when(is_stage("filters"), filter_value).alias("original_value"),
        "stage",
    )
    active = rows.where(F.col("stage").isNull())
    data = active.select(*df.columns)
    if recipe.monthly:
        from tallywright.operators.temporal import monthly

        date, value, how = recipe.monthly
        data = monthly(data, date, value, how).withColumn("row_id", F.concat(F.lit("month-"), dates.month_id(F.col("month"))))
    return Prepared(data, quarantine, _log(rows, recipe, df), _changes(rows, recipe, row_id, df.columns), df)


def _changed(c: str) -> Column:
    return ~F.col(f"before_{c}").cast("string").eqNullSafe(F.col(f"`{c}`").cast("string"))


def _log(rows: DataFrame, recipe: Recipe, df: DataFrame) -> DataFrame:
    """step, column_id, description, affected, invalid, type_before, type_after: a column is listed if something changed or its type or
    role is not the default."""
    kinds_before, kinds_after = dict(df.dtypes), dict(rows.dtypes)
    aggregates = [x for r in recipe.columns for x in (F.count_if(_changed(r.column)).alias(f"a_{r.column}"), F.count_if(F.col(f"invalid_{r.column}")).alias(f"i_{r.column}"))]
    aggregates += [F.count_if(F.col("stage") == "duplicates").alias("a__duplicates"), *[F.count_if((F.col("stage") == "filters") & (F.col("filter_no") == k)).alias(f"a__filter{k}") for k in range(len(recipe.filters))]]
    row = lambda step, column, text, affected, invalid, a, b, show: F.struct(F.lit(step).alias("step"), F.lit(column).cast("string").alias("column_id"), F.lit(text).alias("description"), affected.alias("affected"), invalid.alias("invalid"), F.lit(a).cast("string").alias("type_before"), F.lit(b).cast("string").alias("type_after"), show.alias("show"))
    steps = [row(k + 1, r.column, "column", F.col(f"a_{r.column}"), F.col(f"i_{r.column}"), kinds_before[r.column], kinds_after[r.column], (F.col(f"a_{r.column}") > 0) | F.lit(r.type != "keep" or r.role != "variable")) for k, r in enumerate(recipe.columns)]
    n, zero = len(recipe.columns), F.lit(0).cast("long")
    if recipe.drop_duplicates:
        steps.append(row(n + 1, None, "duplicates", F.col("a__duplicates"), zero, None, None, F.lit(True)))
    steps += [row(n + 2 + k, f.column, f"filter {type(f).__name__}", F.col(f"a__filter{k}"), zero, None, None, F.lit(True)) for k, f in enumerate(recipe.filters)]
    wide = rows.agg(*aggregates)
    if not steps:
        return wide.sparkSession.createDataFrame([], "step int, column_id string, description string, affected long, invalid long, type_before string, type_after string")
    return wide.select(F.explode(F.array(*steps)).alias("s")).select("s.*").where("show").drop("show")


def _changes(rows: DataFrame, recipe: Recipe, row_id: str, columns: list[str]) -> DataFrame:
    """Changed cells: column position, row id, column, before, after."""
    cells = [F.struct(F.lit(columns.index(r.column)).alias("position"), F.lit(r.column).alias("column_id"), F.col(f"before_{r.column}").cast("string").alias("before"), F.col(f"`{r.column}`").cast("string").alias("after"), _changed(r.column).alias("changed")) for r in recipe.columns]
    if not cells:
        return rows.sparkSession.createDataFrame([], "position int, row_id long, column_id string, before string, after string")
    return rows.select(F.col(row_id).alias("row_id"), F.explode(F.array(*cells)).alias("c")).where("c.changed").select("c.position", "row_id", "c.column_id", "c.before", "c.after")


def preview_changes(prepared: Prepared, limit: int = 30) -> DataFrame:
    """The first changed cells in column, then row order: a report of fixed size."""
    return prepared.changes.orderBy("position", "row_id").limit(limit)
