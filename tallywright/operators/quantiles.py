"""Exact quantiles of large columns without gathering them: a sketch gives a bracket for each rank, the rows below it are counted, and
only what lies inside is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.staging import materialize

ACCURACY = 10_000  # a sketch's rank is off by one row in so many at most; a bracket reaches twice as far on either side
MOST_KEYS, SALTS = 10_000, 64  # keys whose brackets are sent to every task; parts that a key's rows are dealt to where keys are more


def finite(value: Column) -> Column:
    """The value as a double, null where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """key (a column's name), v: the finite values of several columns below one another."""
    cells = F.array(*[F.struct(F.lit(c).alias("key"), finite(F.col(f"`{c}`")).alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.key", "x.v").where(F.col("v").isNotNull())


def exact_quantiles(rows: DataFrame, shares: list[float]) -> DataFrame:
    """rows (key, v) → key, n, lo, hi, q: the quantiles in the order of ``shares``, interpolated between the two nearest ranks as
    ``percentile`` does. Null values are left out; a key without values has no row; a null key is a key.

    What is sorted at once is about one in 2,500 of a key's values, each counted once however often it occurs. The brackets are written
    once; rows meet them without being gathered by key."""
    rows = rows.where(F.col("v").isNotNull())
    near = [min(1.0, max(0.0, s + d / ACCURACY)) for s in shares for d in (-2, 2)]
    whole = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", near, ACCURACY).alias("near"))
    whole = materialize(whole, "brackets")
    v, near_by, match = F.col("v"), whole.select(F.col("key").alias("k"), "near"), F.col("key").eqNullSafe(F.col("k"))
    few = whole.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    if few:
        placed = rows.join(F.broadcast(near_by), match)
    else:  # any part of a key's rows finds the key's bracket
        near_by = near_by.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = rows.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(near_by, match & (F.col("salt") == F.col("part")))
    side = lambda i: F.when(v < F.col("near")[2 * i], -1).when(v > F.col("near")[2 * i + 1], 1).otherwise(0)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), side(i).alias("side")) for i in range(len(shares))]))
    # outside the bracket a number and the nearest value are enough; inside each value has its number
    counted = placed.select("key", "v", sides.alias("s")).groupBy("key", "s.i", "s.side", F.when(F.col("s.side") == 0, v).alias("at"))
    counted = counted.agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most")).where((F.col("side") < 1) | F.col("least").isNotNull())
    entries = counted.select("key", "i", "side", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias("v"), "m")
    upto = Window.partitionBy("key", "i").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = whole.select(F.col("key").alias("k"), "n", "lo", "hi")
    ranked = entries.withColumn("upto", F.sum("m").over(upto)).join(F.broadcast(ends) if few else ends, match)
    rank = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("i") + 1) * (F.col("n") - 1)
    low, high = (F.min(F.when(F.col("upto") > f(rank), v)) for f in (F.floor, F.ceil))
    each = ranked.groupBy("key", "i", "n", "lo", "hi").agg(low.alias("a"), high.alias("b"))
    between = F.col("a") + (rank - F.floor(rank)) * (F.col("b") - F.col("a"))
    return each.select("key", "n", "lo", "hi", F.struct("i", between.alias("q")).alias("x")).groupBy("key", "n", "lo", "hi").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("q"))
