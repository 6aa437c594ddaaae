"""Copies of one row or text must not bias what is drawn."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tallywright.llm import language_id, sharding


def test_copies_of_a_row_are_dealt_apart(spark):
    df = spark.range(1600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text")).unionByName(spark.range(1600).select("id", F.lit("x").alias("text")).withColumnRenamed("id", "doc_id")).repartition(5)
    dealt = sharding.shuffle_into_shards(df, 16, ["doc_id", "text"]).collect()
    copies = Counter(r.shard for r in dealt if r.text == "same")
    assert Counter(r.shard for r in dealt) == dict.fromkeys(range(16), 200)
    assert all(60 <= copies[k] <= 140 for k in range(16))  # 100 expected, a deviation of 7
    for k in range(16):  # and within a shard they stand among the others
        slots = sorted(r.slot for r in dealt if r.shard == k and r.text == "same")
        assert slots[0] < 30 and slots[-1] >= 170


def test_copies_do_not_starve_the_sample(spark):
    copies = spark.range(60_000).select(F.lit("de").alias("lang"), F.lit("immer derselbe Text").alias("text"))
    others = spark.range(117).select(F.lit("de").alias("lang"), F.concat(F.lit("ein Text mit Nummer "), F.col("id").cast("string")).alias("text"))
    few = spark.range(40).select(F.lit("en").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    langs, chosen = language_id._sampled(copies.unionByName(others).unionByName(few), "text", "lang", 1000)
    assert langs == ["de", "en"]
    assert Counter(r.lang for r in chosen.collect()) == {"de": 118, "en": 40}
