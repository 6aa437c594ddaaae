"""A text corpus pipeline: five stages, each reading the table the stage before wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. Nulls count as empty
texts; repeated rows count as copies; an empty table gives an empty result; no stage drops a clean document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright import staging
from tallywright.llm import decontam, near_copies, packing, suffix_dedup, toxicity
from tallywright.llm.common import BYTE_BPE, table

REJECT_FROM = 0.7
REPEATED_WORDS = 51  # a passage of over fifty words
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below REJECT_FROM; the scorer learns from all labelled documents of the input."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score_texts(docs.select(*COLUMNS), model, out="__toxicity").where(F.col("__toxicity") < REJECT_FROM).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are 0.8 alike or more: the one whose id is the group's."""
    return near_copies.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of REPEATED_WORDS words or more that occur elsewhere too."""
    cut = suffix_dedup.deduplicate(docs.select(*COLUMNS), words=REPEATED_WORDS, result="text")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the stages learn, tokenize and search; tests/llm/ hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again; what a stage has written for itself goes when
    its result stands (the last one's result is still to be computed)."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{staging.shared_folder(spark)}/{name}"
        with staging.scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
