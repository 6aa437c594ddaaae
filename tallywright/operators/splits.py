"""Validation plans: duplicate blocks, holdouts, group folds and stratified folds, in hash order so that any engine finds the same.

``block`` is a column equal for rows that must stay together (functions.hashing.row_block). Folds are given to distinct blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import seed_of
from tallywright.operators.quantiles import exact_quantiles


def shuffled(block: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), block.cast("string")), 256)


def evaluable_rows(df: DataFrame, target: str, problem: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable target, one row: missing, kept)."""
    ok = F.col(target).isNotNull() if problem == "classification" else F.col(target).try_cast("double").isNotNull() & ~F.isnan(F.col(target).try_cast("double"))
    return df.where(ok), df.agg(F.count_if(~ok).alias("missing"), F.count_if(ok).alias("kept"))


def fold_count(rows: int, blocks: int) -> int:
    """Regression: leave-one-out to 3 rows, few folds below 10, else 5; never more than blocks; 0 where none is possible."""
    k = rows if rows <= 3 else min(3, rows // 2) if rows < 10 else 5
    k = min(k, blocks)
    return k if k >= 2 else 0


def _dealt(blocks: DataFrame, k: int, seed: int, label: str | None = None) -> DataFrame:
    """``blocks`` (a row each) with ``fold`` 1..k: in hash order, of each label where one is named, cut into k parts as even as can be,
    larger ones first. Hashes are even, so their first four digits cut the order into stretches that are ranked apart."""
    hashed = blocks.withColumn("__h", shuffled(F.col("block"), seed)).withColumn("__p", F.substring("__h", 1, 4))
    by = [F.col(label)] if label else [F.lit(0)]
    sizes = hashed.groupBy(*([label] if label else []), "__p").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 stretches
    starts = sizes.select(*([F.col(label).alias("__l")] if label else []), F.col("__p").alias("__q"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"), F.sum("__m").over(Window.partitionBy(*by)).alias("__n"))
    match = F.col("__p") == F.col("__q")
    match = match & F.col(label).eqNullSafe(F.col("__l")) if label else match
    local = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__h")) - 1
    placed = hashed.withColumn("__at", local).join(starts, match)
    at, small = F.col("__start") + F.col("__at"), F.floor(F.col("__n") / k)
    wide = F.col("__n") % k * (small + 1)  # positions in the larger parts
    fold = F.when(at < wide, F.floor(at / (small + 1))).otherwise(F.col("__n") % k + F.floor((at - wide) / F.greatest(small, F.lit(1))))
    return placed.select("block", *([label] if label else []), (fold + 1).cast("int").alias("fold"))


def group_folds(df: DataFrame, block: str, k: int, seed: int) -> DataFrame:
    """block, fold (1..k): distinct blocks in hash order cut into k even parts."""
    return _dealt(df.select(F.col(block).alias("block")).distinct(), k, seed)


def stratified_folds(df: DataFrame, block: str, target: str, k: int, seed: int) -> DataFrame:
    """block, label, fold: as group folds, within each class. A block of several classes is dealt once, with its smallest."""
    return _dealt(df.groupBy(F.col(block).alias("block")).agg(F.min(target).alias("label")), k, seed, "label")


def feasible_stratified(df: DataFrame, block: str, target: str, seed: int, most: int = 5) -> tuple[DataFrame | None, int, str | None]:
    """(folds, k, note): the largest k up to ``most`` and the least class at which every fold holds and trains every class."""
    counts = df.select(block, target).distinct().groupBy(target).count()
    smallest, classes = counts.agg(F.min("count"), F.count(F.lit(1))).first()
    k = min(most, smallest or 0)
    while k >= 2:
        folds = stratified_folds(df, block, target, k, seed)
        pairs = df.select(F.col(block).alias("block"), F.col(target).alias("class")).distinct().join(folds.select("block", "fold"), "block").select("fold", "class").distinct()
        # every fold holds every class; with two folds or more every training part then does too
        held = pairs.groupBy("fold").agg(F.count("class").alias("c")).agg(F.min("c"), F.count(F.lit(1))).first()
        if held[0] == classes and held[1] == k:
            return folds, k, None if k == most else "FOLDS_REDUCED"
        k -= 1
    return None, 0, "CLASS_SUPPORT_INSUFFICIENT"


def materialize_splits(df: DataFrame, folds: DataFrame, block: str, row_id: str, k: int) -> DataFrame:
    """unit_id, row_id, part: each row validates in its block's fold and trains in the others."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(block).alias("block")).join(folds.select("block", "fold"), "block")
    units = rows.withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return units.select(F.concat(F.lit("fold-"), F.col("unit").cast("string")).alias("unit_id"), "row_id", F.when(F.col("fold") == F.col("unit"), "validation").otherwise("train").alias("part"), "block")


def leaking_blocks(splits: DataFrame) -> DataFrame:
    """Blocks on both sides of a unit: must be none."""
    train = splits.where(F.col("part") == "train").select("unit_id", "block").distinct()
    return splits.where(F.col("part") == "validation").select("unit_id", "block").distinct().join(train, ["unit_id", "block"], "left_semi")


def reserve_holdout(df: DataFrame, block: str, target: str, problem: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(block, reserved; one row: rows, reserved_rows, kept_rows, used, reason). A fifth of the blocks, of each class where classes are told,
    if what is left and what is reserved are large enough."""
    blocks = stratified_folds(df, block, target, 5, seed) if problem == "classification" else group_folds(df, block, 5, seed)
    marked = blocks.select("block", (F.col("fold") == 1).alias("reserved"))
    joined = df.select(F.col(block).alias("block"), F.col(target).alias("label")).join(marked, "block")
    per = joined.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("reserved").alias("r")) if problem == "classification" else joined.agg(F.count(F.lit(1)).alias("n"), F.count_if("reserved").alias("r"))
    sums = per.agg(F.sum("n").alias("rows"), F.sum("r").alias("reserved_rows"), F.min("n").alias("least"), F.min("r").alias("least_r"), F.min(F.col("n") - F.col("r")).alias("least_k"))
    kept = F.col("rows") - F.col("reserved_rows")
    reason = F.when(F.col("rows") < 200, "TOO_FEW_ROWS")
    if problem == "classification":
        reason = reason.when(F.col("least") < 25, "CLASS_SUPPORT_INSUFFICIENT").when((F.col("least_r") < 5) | (F.col("least_k") < 10), "HOLDOUT_CLASS_SUPPORT")
    else:
        reason = reason.when((F.col("reserved_rows") < 40) | (kept < 100), "HOLDOUT_TOO_SMALL")
    return marked, sums.select("rows", "reserved_rows", kept.alias("kept_rows"), reason.isNull().alias("used"), reason.alias("reason"))


def confirmation_seed(root: int, problem: str) -> int:
    return seed_of(root, "selection-confirmation", problem)


def confirmation_splits(df: DataFrame, block: str, target: str, problem: str, root: int) -> DataFrame:
    """block, fold: three folds under a seed of their own, over development rows."""
    seed = confirmation_seed(root, problem)
    return stratified_folds(df, block, target, 3, seed).select("block", "fold") if problem == "classification" else group_folds(df, block, 3, seed)


def reference_predictions(df: DataFrame, folds: DataFrame, block: str, row_id: str, target: str, how: str, k: int) -> DataFrame:
    """unit_id, row_id, actual, predicted: the training median, mean or most frequent class (ties to the smallest) of each unit, all
    units in one pass. A unit's training rows are the rows of the other folds."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(block).alias("block"), F.col(target).alias("y")).join(folds.select("block", "fold"), "block")
    if how == "mean":  # sums by fold are enough
        sums = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
        whole = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
        learnt = sums.join(whole, F.lit(True)).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("predicted"))
    elif how == "mode":
        counts = rows.groupBy("fold", "y").count()
        total = counts.groupBy("y").agg(F.sum("count").alias("all"))
        grid = total.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        outside = grid.join(counts, ["fold", "y"], "left").withColumn("n", F.col("all") - F.coalesce("count", F.lit(0)))
        learnt = outside.groupBy("fold").agg(F.min(F.struct((-F.col("n")).alias("m"), "y")).alias("b")).select("fold", F.col("b.y").alias("predicted"))
    else:
        # a unit's values are those of the other folds
        units = rows.withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("unit") != F.col("fold"))
        learnt = exact_quantiles(units.select(F.col("unit").alias("key"), F.col("y").cast("double").alias("v")), [0.5]).select(F.col("key").alias("fold"), F.col("q")[0].alias("predicted"))
    return rows.join(F.broadcast(learnt), "fold").select(F.concat(F.lit("fold-"), F.col("fold").cast("string")).alias("unit_id"), "row_id", F.col("y").alias("actual"), "predicted")


def prediction_checks(pred: DataFrame, splits: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """unit_id, expected, found, not_finite, outside: one finite prediction for each validation row, inside the classes."""
    want = splits.where(F.col("part") == "validation").groupBy("unit_id").agg(F.count(F.lit(1)).alias("expected"))
    bad = F.col("predicted").try_cast("double")
    finite = F.col("predicted").isNull() if labels is not None else bad.isNull() | F.isnan(bad) | (F.abs(bad) == float("inf"))
    p = pred if labels is None else pred.join(labels.select(F.col("label").alias("predicted"), F.lit(True).alias("known")), "predicted", "left")
    outside = F.count_if(F.col("known").isNull()) if labels is not None else F.lit(0).cast("long")
    got = p.groupBy("unit_id").agg(F.count_distinct("row_id").alias("found"), F.count_if(finite).alias("not_finite"), outside.alias("outside"))
    return want.join(got, "unit_id", "left").select("unit_id", "expected", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("found", "not_finite", "outside")])


def eligibility(candidates: DataFrame, splits: DataFrame, features: int, rows: int, problem: str) -> DataFrame:
    """candidates (candidate_id, needs_rows, uses_features) with eligible and reason, by the shortest training part."""
    least = splits.where(F.col("part") == "train").groupBy("unit_id").count().agg(F.min("count").alias("shortest"))
    reason = F.when(F.lit(problem == "regression" and rows <= 3) & F.col("uses_features"), "REFERENCES_ONLY").when(F.col("uses_features") & F.lit(features == 0), "NO_FEATURES").when(F.coalesce("shortest", F.lit(0)) < F.col("needs_rows"), "TRAIN_TOO_SHORT")
    return candidates.join(least, F.lit(True)).select("candidate_id", reason.isNull().alias("eligible"), reason.alias("reason"))
