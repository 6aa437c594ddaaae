"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Each task encodes whole texts and returns one row per distinct length it saw; these are summed by length. From the histogram, sums
over lengths up to and above L give, for any context limit L, the documents that fit, the documents cut, and the tokens kept.

Defined results: a null text is empty and counts as a document of length ``extra`` (the end id); repeated rows count as often as
they occur; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import encoder_of, narrow, text_or_empty

BLOCK = 4096  # lengths per block of the two-level running sums


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text", extra: int = 1) -> DataFrame:
    """(length, n_docs): ``extra`` ids are added to each text for what follows it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, encoder = Counter(), None
        for batch in narrow(batches):
            encoder = encoder or encoder_of(tokenizer)
            lengths.update((encoder.encode(batch.column(0).to_pylist())[1] + extra).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(lengths), pa.int64()), pa.array(list(lengths.values()), pa.int64())], names=["length", "n"])

    return docs.select(text_or_empty(text_col).alias("__text")).mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def _suffix_sums(histogram: DataFrame) -> DataFrame:
    """length, n_docs, and the documents and tokens of at least, and of more than, that length; sums over blocks first, so that no task
    sorts more than BLOCK lengths or the list of blocks."""
    parts = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = parts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), none).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), none).alias("tokens_later"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("docs_later") + F.coalesce(F.sum("n_docs").over(longer), none)).alias("docs_above"),
        (F.col("tokens_later") + F.coalesce(F.sum("tokens").over(longer), none)).alias("tokens_above"),
        "all_docs",
        "all_tokens",
    )


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as the context limit: n_docs of that length, documents and tokens at most L long,
    documents above L, tokens kept when longer documents are cut to L, tokens lost so, and the quantile that L is."""
    lost = F.col("tokens_above") - F.col("docs_above") * F.col("length")
    fit = F.col("all_docs") - F.col("docs_above")
    return _suffix_sums(histogram).select(
        "length",
        "n_docs",
        fit.alias("docs_fit"),
        F.col("docs_above").alias("docs_cut"),
        (F.col("all_tokens") - F.col("tokens_above")).alias("tokens_fit"),
        (F.col("all_tokens") - lost).alias("tokens_kept"),
        lost.alias("tokens_lost"),
        (fit / F.col("all_docs")).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """The same answers at any stated limits, as ``context_limit``: limits that no document is long join the histogram with no document."""
    asked = histogram.sparkSession.createDataFrame([(int(x), 0) for x in sorted(set(limits))], "length long, n_docs long")
    both = histogram.select("length", "n_docs").unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return context_limits(both).join(F.broadcast(asked.select("length")), "length", "left_semi").withColumnRenamed("length", "context_limit")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of the documents does not exceed. An empty histogram has no row."""
    below = F.col("all_docs") - F.col("docs_above") - F.col("n_docs")
    upto = F.col("all_docs") - F.col("docs_above")
    reached = F.filter(F.array(*[F.lit(float(q)) for q in sorted(set(shares))]), lambda q: (q * F.col("all_docs") <= upto) & ((q * F.col("all_docs") > below) | (below == 0)))
    return _suffix_sums(histogram.where(F.col("n_docs") > 0)).select(F.explode(reached).alias("share"), "length")
