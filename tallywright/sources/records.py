"""Records of delimited text, found by many tasks in one file.

A quoted cell may hold line breaks, so where a line is cut off from the lines before it, nobody can tell whether it starts a record. What
can be told is what a line does to either answer: from outside of quotes it ends inside or outside, from inside likewise. Lines are read
in splits, as Spark reads text. One pass composes each split's lines to the split's own effect; effects of splits follow each other in
the order of the file, a row per split; a second pass knows how each split begins and cuts its records. A record that reaches over the
end of its split is joined from its pieces.

Quotes count as the parser counts them: one opens a cell at its start only, a doubled one inside stays inside, any other is a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.staging import materialize

# A line's effect: where it ends from outside (0 or 1), plus twice where it ends from inside, plus four for a blank line.
ENDS_OUTSIDE, KEEPS, ENDS_INSIDE, BLANK = 0, 2, 3, 4


def _ends_inside(line: Column, sep: str, start: int) -> Column:
    """Whether a line ends inside of quotes, begun inside (1) or outside (3: nothing before). 2: just closed, 0: elsewhere outside."""
    before = F.split(line, '"')
    before = F.slice(before, 1, F.size(before) - 1)  # what stands before each quote
    opens = lambda at, text: F.endswith(text, F.lit(sep)) | ((text == "") & at.isin(2, 3))
    return F.aggregate(before, F.lit(start), lambda at, text: F.when(at == 1, 2).when(opens(at, text), 1).otherwise(0)) == 1


def effect(line: Column, sep: str) -> Column:
    quoted = _ends_inside(line, sep, 3).cast("int") + 2 * _ends_inside(line, sep, 1).cast("int")
    return F.when(F.contains(line, F.lit('"')), quoted).when(line.isin("", "\r"), KEEPS + BLANK).otherwise(KEEPS).cast("byte")


def lines_of(spark: SparkSession, path: str, charset: str, sep: str) -> DataFrame:
    """file, block (where the split begins), code (the line's effect), line. Rows of a split come together, in order."""
    text = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    read = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line"))
    first = F.when(F.col("block") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(F.col("line"))
    return read.withColumn("line", first).select("file", "block", effect(F.col("line"), sep).alias("code"), "line")


def _inside(codes: np.ndarray, start: int) -> np.ndarray:
    """Whether each line begins inside of quotes, and whether what follows the last does: one more than there are lines."""
    codes = codes & 3
    n = len(codes)
    fixed = (codes == ENDS_OUTSIDE) | (codes == ENDS_INSIDE)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))  # the last line that settles the answer
    turns = np.cumsum(codes == 1)
    since = turns - np.where(last >= 0, turns[last], 0)
    after = (np.where(last >= 0, codes[last] == ENDS_INSIDE, start == 1) + since) % 2
    return np.concatenate([[start], after]).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of a batch that belong to one split, with (file, block)."""
    if not batch.num_rows:
        return
    file, block = batch.column(0), batch.column(1)
    new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (file[a].as_py(), block[a].as_py()), batch.slice(a, b - a)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, code → a row per split: for either beginning, how it ends, and how many records begin in it."""
    at, state, count = None, [0, 1], [0, 0]
    names = ["file", "block", "ends0", "ends1", "starts0", "starts1"]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), *(pa.array([int(x)], pa.int64()) for x in (at[1], *state, *count))], names=names)

    for batch in batches:
        for where, part in _runs(batch):
            if where != at:
                if at is not None:
                    yield told()
                at, state, count = where, [0, 1], [0, 0]
            codes = part.column(2).to_numpy()
            for k in (0, 1):
                inside = _inside(codes, state[k])
                count[k] += int(((inside[:-1] == 0) & (codes < BLANK)).sum())
                state[k] = int(inside[-1])
    if at is not None:
        yield told()


def splits_of(lines: DataFrame) -> DataFrame:
    """file, block, inside (whether it begins inside of quotes), ends, base (records of the file that begin before it), owner (the split in
    which the record begins that reaches into it). A row per split."""
    told = materialize(lines.select("file", "block", "code").mapInArrow(_effects, "file string, block long, ends0 long, ends1 long, starts0 long, starts1 long"), "effects")
    order = Window.partitionBy("file").orderBy("block")
    # of splits in order: the last one that ends the same way whatever came before, and the turns since
    code = F.col("ends0") + 2 * F.col("ends1")
    told = told.withColumn("fixed", F.when(code.isin(ENDS_OUTSIDE, ENDS_INSIDE), F.struct("block", "ends0")))
    told = told.withColumn("fixed", F.last("fixed", ignorenulls=True).over(order))
    since = Window.partitionBy("file", "fixed").orderBy("block")
    ends = (F.coalesce(F.col("fixed.ends0"), F.lit(0)) + F.sum((code == 1).cast("long")).over(since)) % 2
    told = told.withColumn("ends", ends).withColumn("inside", F.coalesce(F.lag("ends").over(order), F.lit(0)))
    starts = F.when(F.col("inside") == 1, F.col("starts1")).otherwise(F.col("starts0"))
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    return told.select("file", "block", "inside", "ends", F.coalesce(F.sum(starts).over(ahead), F.lit(0)).alias("base"), F.last(F.when(starts > 0, F.col("block")), ignorenulls=True).over(ahead).alias("owner"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, code, line, inside, base, owner → file, owner, block, number, text: records, and pieces of those that reach over the
    split's end, which have an owner."""
    at, state, number, owner = None, 0, 0, None
    held: list[str] = []  # lines of a record that is not closed yet
    names = ["file", "owner", "block", "number", "text"]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)

    def leftover() -> list[tuple]:
        if not held:
            return []
        mine = owner is None
        return [(at[0], at[1] if mine else owner, at[1], number - 1 if mine else None, "\n".join(held))]

    for batch in batches:
        found: list[tuple] = []
        for where, part in _runs(batch):
            if where != at:
                found += leftover()
                first = part.slice(0, 1)
                at, held = where, []
                state, number, owner = (first.column(k)[0].as_py() for k in (4, 5, 6))
                owner = owner if state else None
            codes = part.column(2).to_numpy()
            inside = _inside(codes, state)
            state = int(inside[-1])
            lines = part.column(3).to_pylist()
            for line, begun, open_after, code in zip(lines, inside[:-1].tolist(), inside[1:].tolist(), codes.tolist(), strict=True):
                if not begun:
                    if code >= BLANK:
                        continue
                    number += 1
                    owner = None
                held.append(line)
                if not open_after:
                    found.append((at[0], owner, at[1], None if owner is not None else number - 1, "\n".join(held)))
                    held = []
        yield rows(found)
    yield rows(leftover())


def records(spark: SparkSession, path: str, charset: str, sep: str) -> DataFrame:
    """file, number (0, 1, ... in each file), text: the records that are not blank, without the line break at their end. Line breaks inside
    of quotes stay as they are."""
    lines = lines_of(spark, path, charset, sep)
    splits = materialize(splits_of(lines), "splits")
    out = "file string, owner long, block long, number long, text string"

    def cut(which: DataFrame) -> DataFrame:
        known = lines.join(F.broadcast(which), ["file", "block"])  # a row per split
        return known.select("file", "block", "code", "line", "inside", "base", "owner").mapInArrow(_cut, out)

    whole = cut(splits).where(F.col("owner").isNull()).select("file", "number", "text")
    over = splits.where((F.col("inside") == 1) | (F.col("ends") == 1))
    if over.limit(1).count():
        pieces = cut(over).where(F.col("owner").isNotNull()).groupBy("file", "owner").agg(F.min("number").alias("number"), F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))  # a record's
        whole = whole.unionByName(pieces.select("file", "number", F.array_join(F.col("pieces.text"), "\n").alias("text")))
    return whole.withColumn("text", F.regexp_replace("text", r"\r\z", ""))
