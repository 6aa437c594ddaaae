"""Profiles: counts per table and column, semantic types, possible ids, boxplots, correlations, patterns in text, and suggestions.

All rows are read; nothing is sampled unless asked for. Column statistics come from wide aggregates (a fixed number of columns at a
time) that are turned into rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import row_mark
from tallywright.functions.numbers import CURRENCIES, has_currency
from tallywright.functions.text import looks_like_id, safe_example, trim_text
from tallywright.operators.quantiles import exact_quantiles, stacked
from tallywright.operators.tables import even_sample
from tallywright.staging import materialize

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
CHUNK = 50  # columns per wide aggregate
ISO = r"^\d{4}[-/]\d{1,2}([-/]\d{1,2})?$"
DAY_FIRST = r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def is_date(kind: str) -> bool:
    return kind in ("date", "timestamp", "timestamp_ntz")


def _cell(df: DataFrame, c: str) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) if dict(df.dtypes)[c] in ("double", "float") else F.col(f"`{c}`")


def table_profile(df: DataFrame) -> DataFrame:
    """row_count, column_count, duplicate_rows (rows after the first of each group of equal rows). Rows are told by a 128-bit hash."""
    groups = df.select(row_mark(*[F.col(f"`{c}`") for c in df.columns]).alias("mark")).groupBy("mark").count()
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def _unpivot(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """stats(column) → named aggregates; one row per column, a chunk of columns per pass."""
    out = None
    for k in range(0, len(columns), CHUNK):
        part = columns[k : k + CHUNK]
        named = {c: stats(c) for c in part}
        wide = df.agg(*[v.alias(f"{i}_{n}") for i, c in enumerate(part) for n, v in named[c].items()])
        rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_id"), F.lit(df.columns.index(c)).alias("position"), *[F.col(f"{i}_{n}").alias(n) for n in named[c]]) for i, c in enumerate(part)])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def semantic_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_id, position, semantic_type: numeric and date types by schema; text as dates where a date shape fits 90 % of its values."""
    kinds = dict(df.dtypes)

    def stats(c: str) -> dict[str, Column]:
        text = trim_text(F.col(f"`{c}`").cast("string"))
        shape = F.greatest(F.avg(F.when(text.isNotNull(), text.rlike(ISO).cast("double"))), F.avg(F.when(text.isNotNull(), text.rlike(DAY_FIRST).cast("double")))) if kinds[c] == "string" else F.max(F.lit(0.0))
        fixed = "numeric" if is_numeric(kinds[c]) else "datetime" if is_date(kinds[c]) else None
        return {"semantic_type": F.lit(fixed) if fixed else F.when(shape >= 0.9, "datetime").otherwise("categorical")}

    return _unpivot(df, columns or df.columns, stats)


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_id, exact: different non-null cells of each column. Each column is read by itself and tasks count first, so no pass holds
    rows times columns; texts are told by 128-bit hashes."""
    kinds, out = dict(df.dtypes), None
    for c in columns:
        cell = _cell(df, c)
        plain = is_numeric(kinds[c]) or is_date(kinds[c]) or kinds[c] == "boolean"
        cells = df.select(cell.alias("v")).where(F.col("v").isNotNull()).select(F.col("v") if plain else row_mark(F.col("v")).alias("v")).distinct()
        row = cells.agg(F.count(F.lit(1)).alias("exact")).select(F.lit(c).alias("column_id"), "exact")
        out = row if out is None else out.unionByName(row)
    return out


NEAR_ID = 0.9  # share of different cells from which a sketch is not trusted to tell whether there are 98 %


def column_profile(df: DataFrame, roles: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """column_id, position, semantic_type, role, non_null, null_count, distinct_count, possible_id, issues.

    One pass over all columns takes counts, extremes and, unless ``exact``, sketches. Exact distinct counts follow column by column: of
    all columns where ``exact``, else only of those whose sketch is near the share that makes an identifier, so that its rule is decided
    exactly; elsewhere ``distinct_count`` is then the sketch's (within 3 %)."""
    roles, kinds = roles or {}, dict(df.dtypes)

    def stats(c: str) -> dict[str, Column]:
        cell = _cell(df, c)
        text = trim_text(cell.cast("string"))
        share = F.greatest(F.avg(text.rlike(ISO).cast("double")), F.avg(text.rlike(DAY_FIRST).cast("double"))) if kinds[c] == "string" else F.max(F.lit(0.0))
        value = cell + F.lit(0.0) if kinds[c] in ("double", "float") else cell.cast("string")  # -0.0 is 0.0
        sketch = F.lit(None).cast("long") if exact else F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(F.when(cell.isNotNull(), value)), F.lit(14)))
        some = F.xxhash64(value)
        return {"non_null": F.count(cell), "null_count": F.count(F.lit(1)) - F.count(cell), "mean_length": F.avg(F.length(text)), "share": share, "sketch": F.max(sketch) if exact else sketch - F.when(F.count(cell) < F.count(F.lit(1)), 1).otherwise(0), "one_value": F.coalesce(F.min(F.when(cell.isNotNull(), some)) == F.max(F.when(cell.isNotNull(), some)), F.lit(True))}

    rows = _unpivot(df, df.columns, stats)
    if exact:
        asked = df.columns
    else:
        rows = materialize(rows, "profile")
        near = rows.where((F.col("non_null") >= 10) & (F.col("sketch") >= NEAR_ID * F.col("non_null")))
        asked = sorted((r["column_id"] for r in near.select("column_id").collect()), key=df.columns.index)  # a row per column
    known = distinct_counts(df, asked) if asked else df.sparkSession.createDataFrame([], "column_id string, exact long")
    rows = rows.join(known, "column_id", "left").withColumn("distinct_count", F.coalesce("exact", F.when(F.col("one_value"), F.least("non_null", F.lit(1))).otherwise(F.greatest("sketch", F.lit(2)))))
    named = {c: (is_numeric(kinds[c]), is_date(kinds[c]), looks_like_id(c), roles.get(c, "variable")) for c in df.columns}
    told = F.element_at(F.array(*[F.struct(F.lit(a).alias("numeric"), F.lit(d).alias("date"), F.lit(i).alias("id"), F.lit(r).alias("role")) for a, d, i, r in named.values()]), F.col("position") + 1)
    rows = rows.withColumn("told", told)
    kind = F.when(F.col("told.numeric"), "numeric").when(F.col("told.date") | F.coalesce(F.col("share") >= 0.9, F.lit(False)), "datetime").otherwise("categorical")
    ratio = F.col("distinct_count") / F.nullif(F.col("non_null"), F.lit(0))
    possible = F.coalesce((F.col("non_null") >= 10) & (kind != "datetime") & (ratio >= 0.98) & (F.col("told.id") | (~F.col("told.numeric") & (F.col("mean_length") >= 8))), F.lit(False))
    issues = F.array_compact(F.array(F.when(F.col("null_count") > 0, "MISSING_VALUES"), F.when(F.col("distinct_count") <= 1, "CONSTANT_OR_EMPTY"), F.when(possible, "POSSIBLE_IDENTIFIER")))
    return rows.select("column_id", "position", kind.alias("semantic_type"), F.col("told.role").alias("role"), "non_null", "null_count", "distinct_count", possible.alias("possible_id"), issues.alias("issues"))


def examples(df: DataFrame, column: str, order_by: str, k: int = 4) -> DataFrame:
    """The first k non-null values in the order given: a report of fixed size."""
    return df.where(F.col(column).isNotNull()).orderBy(order_by).limit(k).select(F.lit(column).alias("column_id"), F.col(order_by).alias("at"), safe_example(F.col(column)).alias("example"))


def quality(df: DataFrame, version: str) -> DataFrame:
    kinds = dict(df.dtypes)
    missing = sum((F.count_if(_cell(df, c).isNull()) for c in df.columns), F.lit(0).cast("long"))
    cells = df.agg(F.count(F.lit(1)).alias("row_count"), missing.alias("missing_cells"))
    copies = table_profile(df).select("duplicate_rows")
    return cells.join(copies, F.lit(True)).select(F.lit(version).alias("version"), "row_count", F.lit(sum(is_numeric(k) for k in kinds.values())).cast("long").alias("numeric_columns"), F.lit(sum(is_date(k) for k in kinds.values())).cast("long").alias("date_columns"), "missing_cells", "duplicate_rows")


def quality_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    return quality(before, "before").unionByName(quality(after, "after"))


def boxplots(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_id, n, q1, median, q3, low_whisker, high_whisker, outliers. Whiskers are the extreme values within 1.5 IQR of the box."""
    rows = stacked(df, columns)
    boxes = exact_quantiles(rows, [0.25, 0.5, 0.75]).select(F.col("key").alias("column_id"), "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    v, reach = F.col("v"), (F.col("q3") - F.col("q1")) * 1.5
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    box = ["column_id", "n", "q1", "median", "q3"]
    reached = rows.join(F.broadcast(boxes), F.col("key") == F.col("column_id")).groupBy(*box).agg(F.min(F.when(inside, v)).alias("a"), F.max(F.when(inside, v)).alias("b"), F.count_if(~inside).alias("outliers"))  # a row per column
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_id string")
    joined = names.join(reached, "column_id", "left")
    return joined.select("column_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "q1", "median", "q3", F.coalesce("a", "q1").alias("low_whisker"), F.coalesce("b", "q3").alias("high_whisker"), F.coalesce("outliers", F.lit(0)).cast("long").alias("outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """left, right, r over rows where both are present; null below three such rows or where either is constant."""
    pairs = list(combinations(columns, 2))
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggregates.append(F.when((F.count(x) >= 3) & (spread > 0), F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias(str(i)))
    wide = df.agg(*aggregates)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(str(i)).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def top_pairs(corr: DataFrame, k: int = 3) -> DataFrame:
    return corr.where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), F.desc("left"), F.desc("right")).limit(k)


def _written(c: str) -> Column:
    """The trimmed text of a cell, null where it is blank."""
    text = trim_text(F.col(f"`{c}`").cast("string"))
    return F.when(text != "", text)


def _number_counts(v: Column) -> dict[str, Column]:
    bare = F.regexp_replace(v, r"(S/|US\$|PEN|USD|EUR|[$€%\s])", "")
    tail = lambda mark: v.rlike(rf"[{mark}]\d{{1,4}}\s*%?$")
    return {
        "n": F.count(v),
        "ok": F.count_if(bare.rlike(r"^[+\-]?\d[\d.,]*$")),
        "pct": F.count_if(v.endswith("%")),
        "comma": F.count_if(tail(",")),
        "dot": F.count_if(tail(".")),
        "has_comma": F.count_if(F.contains(v, F.lit(","))),
        "has_dot": F.count_if(F.contains(v, F.lit("."))),
        **{c: F.count_if(has_currency(v, c)) for c in CURRENCIES},
    }


def _date_counts(v: Column) -> dict[str, Column]:
    day_first = v.rlike(DAY_FIRST)
    a = F.when(day_first, F.regexp_extract(v, r"^(\d{1,2})", 1).cast("int"))
    b = F.when(day_first, F.regexp_extract(v, r"^\d{1,2}[-/](\d{1,2})", 1).cast("int"))
    return {"n": F.count(v), "iso": F.count_if(v.rlike(ISO)), "dmy": F.count_if(day_first), "ambiguous": F.coalesce(F.bool_or((a <= 12) & (b <= 12)), F.lit(False))}


def _share(g: dict[str, Column], what: Column) -> Column:
    return what / F.nullif(g["n"], F.lit(0))


def numeric_pattern(df: DataFrame, column: str) -> DataFrame:
    """One row: how a text column writes numbers: n, share parsed, percent, decimal mark, thousands mark, currency, mixed."""
    aggregates = _number_counts(_written(column))
    g = {k: F.col(f"`{k}`") for k in aggregates}
    least = F.greatest(F.lit(2), F.ceil(g["n"] * 0.6))
    decimal = F.when((g["comma"] >= least) & (g["comma"] > g["dot"]), ",").when((g["dot"] >= least) & (g["dot"] >= g["comma"]), ".")
    found = F.array_compact(F.array(*[F.when(g[c] > 0, c) for c in CURRENCIES]))
    counts = df.agg(*[v.alias(k) for k, v in aggregates.items()])
    return counts.select("n", _share(g, g["ok"]).alias("share"), (g["pct"] >= 0.8 * g["n"]).alias("percent"), decimal.alias("decimal_mark"), F.when((decimal == ",") & (g["has_dot"] >= 2), ".").when((decimal == ".") & (g["has_comma"] >= 2), ",").alias("thousands_mark"), F.when(F.size(found) == 1, found[0]).alias("currency"), (F.size(found) > 1).alias("mixed"))


def date_pattern(df: DataFrame, column: str) -> DataFrame:
    """One row: n, share, ambiguous, recommended order of a text column that may hold dates."""
    aggregates = _date_counts(_written(column))
    g = {k: F.col(k) for k in aggregates}
    share = _share(g, F.greatest("iso", "dmy"))
    counts = df.agg(*[v.alias(k) for k, v in aggregates.items()])
    return counts.select("n", share.alias("share"), "ambiguous", F.when((share >= 0.9) & (g["iso"] >= g["dmy"]), "YMD").when((share >= 0.9) & ~g["ambiguous"], "DMY").alias("recommended"))


def _text_patterns(df: DataFrame) -> DataFrame:
    """c, number, mixed, date, ambiguous, trim, blank of each text column, a chunk of columns per pass."""
    texts, out = [c for c, k in df.dtypes if k == "string"], None
    for k in range(0, len(texts), CHUNK):
        part, wide, rows = texts[k : k + CHUNK], [], []
        for i, c in enumerate(part):
            t = F.col(f"`{c}`")
            own = {"trim": F.bool_or(trim_text(t) != t), "blank": F.bool_or(trim_text(t) == "")}
            aggregates = {**_number_counts(_written(c)), **_date_counts(_written(c)), **own}
            wide += [v.alias(f"{i} {n}") for n, v in aggregates.items()]
            g = {n: F.col(f"`{i} {n}`") for n in aggregates}
            used = sum((F.when(g[x] > 0, 1).otherwise(0) for x in CURRENCIES), F.lit(0))
            rows.append(F.struct(F.lit(c).alias("c"), (_share(g, g["ok"]) >= 0.9).alias("number"), (used > 1).alias("mixed"), (_share(g, F.greatest(g["iso"], g["dmy"])) >= 0.9).alias("date"), g["ambiguous"].alias("ambiguous"), g["trim"].alias("trim"), g["blank"].alias("blank")))
        found = df.agg(*wide).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "c string, number boolean, mixed boolean, date boolean, ambiguous boolean, trim boolean, blank boolean")
    return out


def suggest_preparation(df: DataFrame) -> DataFrame:
    """column_id, type, role, trim, empty_to_null, alert."""
    base, out = column_profile(df), _text_patterns(df)
    j = base.join(out, base.column_id == out.c, "left")
    no = F.lit(False)
    date, number = F.coalesce("date", no), F.coalesce("number", no)
    kind = F.when(date, "date").when(number, "numeric").when(F.col("semantic_type") == "numeric", "numeric").when(F.col("semantic_type") == "datetime", "date").otherwise("category")
    alert = F.when(date & F.coalesce("ambiguous", no), "AMBIGUOUS_DATE").when(date, "DATE_STORED_AS_TEXT").when(number & F.coalesce("mixed", no), "MIXED_CURRENCIES").when(number, "NUMBER_STORED_AS_TEXT")
    role = F.when(F.col("distinct_count") <= 1, "ignore").when(F.col("possible_id"), "identifier").otherwise("variable")
    return j.select("column_id", kind.alias("type"), role.alias("role"), F.coalesce("trim", no).alias("trim"), F.coalesce("blank", no).alias("empty_to_null"), alert.alias("alert"))


def usable_features(profile: DataFrame, target: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    keep = F.col("column_id") != target
    if include is not None:
        keep = keep & F.col("column_id").isin(*include) if include else F.lit(False)
    if exclude:
        keep = keep & ~F.col("column_id").isin(*exclude)
    return profile.where(keep & ~F.col("possible_id") & (F.col("distinct_count") > 1))


def resolve_features(profile: DataFrame, target: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """column_id, reason: null for a feature, else why not. Identifier and ignored roles are never features."""
    names = [r[0] for r in profile.select("column_id").collect()]  # a row per column
    unknown = sorted((set(include or ()) | set(exclude or ())) - set(names))
    if unknown:
        raise ValueError(f"UNKNOWN_COLUMNS: {unknown}")
    if both := sorted((set(include or ()) & set(exclude or ())) - {target}):
        raise ValueError(f"OVERLAPPING_COLUMNS: {both}")
    reason = F.when(F.col("column_id") == target, "TARGET").when(F.col("role") != "variable", "ROLE")
    if include is not None:
        reason = reason.when(~F.col("column_id").isin(*include) if include else F.lit(True), "NOT_INCLUDED")
    if exclude:
        reason = reason.when(F.col("column_id").isin(*exclude), "EXCLUDED")
    return profile.select("column_id", reason.alias("reason"))


def scenario_controls(df: DataFrame, numeric: list[str], categorical: list[str], top: int = 20) -> DataFrame:
    """One row per numeric feature (low P1, high P99, median default, step) and up to ``top`` per category (option, rank, share of rows)."""
    out = None
    if numeric:
        low, high = (F.when(F.col("q")[0] < F.col("q")[1], F.col("q")[k]).otherwise(F.col(c)) for k, c in enumerate(("lo", "hi")))
        none = F.lit(None)
        limits = exact_quantiles(stacked(df, numeric), [0.01, 0.99, 0.5]).select("key", low.alias("low"), high.alias("high"), F.col("q")[2].alias("middle"))
        out = df.sparkSession.createDataFrame([(c,) for c in numeric], "key string").join(limits, "key", "left").select(F.col("key").alias("column_id"), F.lit("numeric").alias("kind"), "low", "high", "middle", ((F.col("high") - F.col("low")) / 100).alias("step"), none.cast("string").alias("option"), none.cast("int").alias("rank"), F.lit(False).alias("truncated"))
    for c in categorical:
        counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("option")).count()
        n = counts.agg(F.count(F.lit(1)).alias("options"))
        best = counts.orderBy(F.desc("count"), "option").limit(top)
        row = best.join(n, F.lit(True)).select(F.lit(c).alias("column_id"), F.lit("category").alias("kind"), *[F.lit(None).cast("double").alias(x) for x in ("low", "high", "middle", "step")], "option", F.row_number().over(Window.orderBy(F.desc("count"), "option")).alias("rank"), (F.col("options") > top).alias("truncated"))
        out = row if out is None else out.unionByName(row)
    return out


def pair_points(df: DataFrame, pairs: DataFrame, row_id: str, limit: int = 500) -> DataFrame:
    """left, right, row_id, x, y: for each pair (left, right) up to ``limit`` rows that have both values, evenly spread in row id order."""
    out = None
    for p in pairs.select("left", "right").collect():  # the few pairs of a report
        x, y = (F.col(f"`{c}`").cast("double") for c in (p["left"], p["right"]))
        both = df.where(x.isNotNull() & y.isNotNull()).select(F.col(row_id).alias("row_id"), x.alias("x"), y.alias("y"))
        points = even_sample(both, ["row_id"], limit).select(F.lit(p["left"]).alias("left"), F.lit(p["right"]).alias("right"), "row_id", "x", "y")
        out = points if out is None else out.unionByName(points)
    return df.sparkSession.createDataFrame([], "left string, right string, row_id long, x double, y double") if out is None else out
