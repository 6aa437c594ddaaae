"""Filter interaction audit: what each of five filters removes, and what it would have removed, under all 120 orders of them.

Every row is judged by all filters at once; which of them it fails is its mask. Rows are counted by part, mask and label: those cells are
all that is left of the table. Each cell then folds across the array of orders with ``aggregate`` and ``transform``: an order is walked
filter by filter, the cell being gone after the first that it fails. A cell yields 600 structs (order, step), weighted by its rows, and
the cells of a part merge by elementwise sums.

Whether a row fails E is told without a join on texts: of each text, the rows of its smallest id pass. They are found by a minimum that
tasks take first, so no task gathers the rows of a common text; all other rows fail. Texts are told by SHA-256.

Defined results: a null text counts as empty (no word: it fails A alone, and E where a smaller id's text is empty); a null id is no smaller
than any and fails E nowhere; rows that repeat an id and its text share their smallest id, so all of them pass E; of several labels of one
id any 1 counts, a missing or null label is 0; a null part is the empty string; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import materialize

FILTERS = "ABCDE"
LEAST_WORDS, SIGNS = 200, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def orders() -> Column:
    """All orders of the filters, as one constant array that goes out with the plan."""
    return F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])


def failures(text: Column, words: Column) -> Column:
    """The letters of the filters among A to D that a text fails, in order. ``words``: its words."""
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return F.concat(
        F.when(n < LEAST_WORDS, "A").otherwise(""),
        F.when(F.size(F.array_distinct(words)) * 100 < n * 50, "B").otherwise(""),
        F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * 3, "C").otherwise(""),
        F.when(text.rlike(SIGNS), "D").otherwise(""),
    )


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: rows by part, by the filters that they fail (letters in order) and by label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), text.alias("text"))
    judged = judged.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    judged = judged.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), failures(F.col("text"), F.col("words")).alias("mask"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    judged = judged.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    cell = ["part", "mask", "good", "toxic"]
    # a row per text and id; several parts only where rows repeat an id
    of_id = judged.groupBy("same", "id", *cell).agg(F.count(F.lit(1)).alias("n")).groupBy("same", "id").agg(F.collect_list(F.struct(*cell, "n")).alias("cells"))
    of_id = materialize(of_id, "judged")  # read twice; texts are read once
    first = of_id.where(F.col("id").isNotNull()).groupBy("same").agg(F.min_by("cells", "id").alias("cells"))
    passing = first.unionByName(of_id.where(F.col("id").isNull()).select("same", "cells")).select(F.inline("cells"))
    known = of_id.select(F.inline("cells"))
    counted = known.select(*cell, "n", F.lit(0).cast("long").alias("passed")).unionByName(passing.select(*cell, F.lit(0).cast("long").alias("n"), F.col("n").alias("passed")))
    counted = counted.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    both = F.inline(F.array(F.struct("mask", F.col("passed").alias("n")), F.struct(F.concat("mask", F.lit("E")).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    return counted.select("part", "good", "toxic", both).where(F.col("n") > 0).select("part", "mask", "good", "toxic", "n")


def _steps(order: Column, mask: Column, good: Column, toxic: Column, n: Column) -> Column:
    """One order walked for one cell: a struct for each step."""
    zero = F.lit(0).cast("long")

    def step(done: Column, k: Column) -> Column:
        letter = F.substring(order, k, F.lit(1))
        fails = F.contains(mask, letter)
        now = fails & ~done["gone"]
        at = F.struct(
            order.alias("filter_order"),
            k.alias("step"),
            F.when(done["gone"] | fails, zero).otherwise(n).alias("kept"),
            F.when(now, n).otherwise(zero).alias("removed"),
            F.when(fails & done["gone"], n).otherwise(zero).alias("redundant"),
            F.when(mask == letter, n).otherwise(zero).alias("unique_fails"),
            F.when(now, n * good).otherwise(zero).alias("good_lost"),
            F.when(now, n * toxic).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct((done["gone"] | fails).alias("gone"), F.concat(done["steps"], F.array(at)).alias("steps"))

    kind = "array<struct<filter_order:string,step:int,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>"
    nothing = F.struct(F.lit(False).alias("gone"), F.array().cast(kind).alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), nothing, step, lambda done: done["steps"])


def _first_failures(all_orders: Column, mask: Column) -> Column:
    """For each filter, in how many orders it is the one that removes a cell with this mask."""
    letters = F.array(*map(F.lit, FILTERS))
    first = lambda order: F.element_at(F.filter(F.split(order, ""), lambda x: F.contains(mask, x)), 1)
    add = lambda sums, order: F.zip_with(sums, letters, lambda s, x: s + F.when((mask != "") & (first(order) == x), 1).otherwise(0).cast("long"))
    return F.aggregate(all_orders, F.array_repeat(F.lit(0).cast("long"), len(FILTERS)), add)


def audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    order = F.col("all_orders")
    folded = cells.withColumn("all_orders", orders()).select(
        "part",
        F.flatten(F.transform(order, lambda o: _steps(o, F.col("mask"), F.col("good"), F.col("toxic"), F.col("n")))).alias("steps"),
        F.transform(_first_failures(order, F.col("mask")), lambda x: x * F.col("n")).alias("shares"),
    )
    shares = F.element_at("shares", F.position(F.substring(F.col("at.filter_order"), F.col("at.step"), F.lit(1)), F.lit(FILTERS)))
    rows = folded.select("part", "shares", F.explode("steps").alias("at")).select("part", "at.*", shares.alias("shapley"))
    sums = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return rows.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in sums])
