from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywright.functions import dates, hashing, numbers, text


def one(spark, values, expression):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[1] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_text(spark):
    assert one(spark, ["\t a  \n", "", None], text.trim_text) == ["a", "", None]
    assert one(spark, ["  ", "x", None], text.empty_to_null) == [None, "x", None]
    assert one(spark, ["a", "c", None], lambda c: text.merge_categories(c, {"a": "b"})) == ["b", "c", None]
    assert one(spark, ["=1", "-5", "@x", "ok"], text.formula_safe) == ["'=1", "'-5", "'@x", "ok"]
    assert one(spark, ["=1", "-5", "+1.5"], lambda c: text.formula_safe(c, True)) == ["'=1", "-5", "+1.5"]
    assert one(spark, ["a\nb" + "c" * 200], text.safe_example)[0] == "a b" + "c" * 117
    assert text.looks_like_id("Cliente_ID") and text.looks_like_id("Operación") and not text.looks_like_id("edad")


@pytest.mark.parametrize(
    ("value", "how", "want"),
    [
        ("1.234,50", {"decimal": ",", "thousands": "."}, 1234.5),
        ("1,234.50", {"thousands": ","}, 1234.5),
        ("15%", {"percent": True}, 0.15),
        ("S/ 1,234.50", {"thousands": ",", "currency": "PEN"}, 1234.5),
        ("15%", {}, None),
        ("15", {"percent": True}, None),
        ("1.5d", {}, None),
        ("NaN", {}, None),
        ("abc", {}, None),
    ],
)
def test_numbers(spark, value, how, want):
    got = one(spark, [value, None], lambda c: numbers.parse_number(c, **how))
    assert got[0].value == (pytest.approx(want) if want is not None else None) and got[0].invalid == (want is None)
    assert got[1].value is None and not got[1].invalid


def test_dates(spark):
    day = dt.date(2026, 3, 15)
    for value, order in (("15/03/2026", "DMY"), ("03/15/2026", "MDY"), ("2026-03-15", "YMD"), (" 15-3-2026 10:20:30 ", "DMY"), ("2026-03-15T01:02:03", "YMD"), ("15/03/2026", "UNAMBIGUOUS"), ("03/15/2026", "UNAMBIGUOUS")):
        assert one(spark, [value], lambda c, o=order: dates.parse_date(c, o))[0].value == day, (value, order)
    for value, order in (("01/02/2026", "UNAMBIGUOUS"), ("31/02/2026", "DMY"), ("15/03/26", "DMY"), ("imposible", "YMD")):
        got = one(spark, [value], lambda c, o=order: dates.parse_date(c, o))[0]
        assert got.value is None and got.invalid
    assert one(spark, ["46024", "0", "x", None], dates.serial_date) == [dt.date(2026, 1, 2), None, None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.dates(dt.date(1990, 1, 1), dt.date(2090, 1, 1)), st.integers(-(10**9), 10**9)), min_size=1, max_size=30))
def test_round_trips(spark, rows):
    texts = [f"{d:%d/%m/%Y}" for d, _ in rows]
    assert [x.value for x in one(spark, texts, lambda c: dates.parse_date(c, "DMY"))] == [d for d, _ in rows]
    amounts = [f"{n / 100:,.2f}".translate(str.maketrans(",.", ".,")) for _, n in rows]
    assert [x.value for x in one(spark, amounts, lambda c: numbers.parse_number(c, ",", "."))] == [pytest.approx(n / 100) for _, n in rows]


def test_hashing(spark):
    assert one(spark, ["a"], lambda c: hashing.stable_seed(F.lit(42), c, F.lit("u1")))[0] == hashing.seed_of(42, "a", "u1")
    df = spark.createDataFrame([(1, None), (1, ""), (1, None)], "a int, b string")
    assert df.groupBy(hashing.row_block(F.col("a"), F.col("b"))).count().count() == 2
    assert hashing.table_digest(df).collect() == hashing.table_digest(df.orderBy(F.desc("b"))).collect()
    assert hashing.canonical_hash({"b": 1, "a": 2}) == hashing.canonical_hash({"a": 2, "b": 1})
