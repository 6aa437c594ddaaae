"""Delimited text read by many tasks, and heads of files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallywright.sources import files
from tallywright.sources.records import records


@pytest.fixture
def small_splits(spark):
    """Splits of a few dozen bytes, so that records reach over several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(rng):
    return "".join(rng.choices(["a", "é", " ", '"', "\n", "\r\n", ";", ",", "|", "long " * 9, '""', "x"], k=rng.choice([0, 1, 3, 8])))


@pytest.mark.parametrize(("seed", "size", "end"), [(1, 40, "\n"), (2, 90, "\r\n"), (3, 1 << 20, "\r\n")])
def test_split_files_hold_the_records_of_a_plain_reader(spark, tmp_path, small_splits, seed, size, end):
    rng = random.Random(seed)
    for name in ("a", "b"):
        rows = [["n", "t", "u"]] + [[str(k), cell(rng), cell(rng)] for k in range(14)]
        with (tmp_path / f"{name}.csv").open("w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=end).writerows(rows)
            f.write(end + end)  # blank lines are no records
    small_splits(size)
    want = {}
    for name in ("a", "b"):
        with (tmp_path / f"{name}.csv").open(newline="", encoding="utf-8") as f:
            want[name] = [r for r in csv.reader(f) if r]
    found = {}
    for r in records(spark, str(tmp_path), "UTF-8", ",").collect():
        found.setdefault(r.file[-5], {})[r.number] = next(csv.reader(io.StringIO(r.text, newline="")))
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == want
    if size < 1000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    # cells with a carriage return before LF are left as they are
    got = files.read_csv(spark, str(tmp_path))
    rows = [(int(r[0]), r[1] or None, r[2] or None) for name in ("a", "b") for r in want[name][1:]]
    assert sorted(((r.n, r.t or None, r.u or None) for r in got.collect()), key=str) == sorted(rows, key=str)


def test_quotes_that_open_nothing(spark, tmp_path, small_splits):
    text = 'n,t\n1,5" pipe\n2,"a ""b"" c\n\nd"\n3,x "y" z\n4,"",\n5,"e\n,""\nf",g\n'
    (tmp_path / "q.csv").write_text(text)
    want = [r for r in csv.reader(io.StringIO(text)) if r]
    for size in (11, 1000):
        small_splits(size)
        got = {r.number: next(csv.reader(io.StringIO(r.text, newline=""))) for r in records(spark, str(tmp_path), "UTF-8", ",").collect()}
        assert [got[k] for k in range(len(got))] == want


def test_a_record_over_many_splits_and_one_that_never_ends(spark, tmp_path, small_splits):
    inner = "\n".join(f"line {k}" for k in range(40))
    (tmp_path / "r.csv").write_text(f'n,t\n1,"{inner}"\n2,b\n3,"open\nto the end')
    small_splits(64)
    got = {r.number: r.text for r in records(spark, str(tmp_path), "UTF-8", ",").collect()}
    assert got == {0: "n,t", 1: f'1,"{inner}"', 2: "2,b", 3: '3,"open\nto the end'}


def test_types_names_and_widths(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,b,,b,d,e,f,g\n1,3000000000,x,1.5,2020-01-02,2020-01-02 03:04:05,true,\n-7,2,,1e3,2021-01-02,2020-01-02,FALSE,\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("a", "int"), ("b1", "bigint"), ("_c2", "string"), ("b3", "double"), ("d", "date"), ("e", "timestamp"), ("f", "boolean"), ("g", "string")]
    (tmp_path / "w.csv").write_text("x\n" + ",".join(f"c{k}" for k in range(301)) + "\n" + ",".join("1" * 301) + "\n")
    with pytest.raises(ValueError, match="MAX_COLUMNS_EXCEEDED"):
        files.read_csv(spark, str(tmp_path / "w.csv"), header_row=1)
    with pytest.raises(ValueError, match="HEADER_MISSING"):
        files.read_csv(spark, str(tmp_path / "w.csv"), header_row=9)
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="HEADER_MISSING"):
        files.read_csv(spark, str(tmp_path / "e.csv"))


def test_of_a_large_file_only_the_head_is_read(spark, tmp_path):
    with (tmp_path / "big.csv").open("wb") as f:
        f.write("é;y\n".encode() * 20_000)
        f.truncate(3 << 30)  # a hole: reading it whole would take 3 GB
    (tmp_path / "small.csv").write_bytes(b"x|y")
    found = {r.path[-7:]: (len(r.head), r.size_bytes) for r in files.heads(spark, str(tmp_path)).collect()}
    assert found == {"big.csv": (65_536, 3 << 30), "all.csv": (3, 3)}
    seen = {r.path[-7:]: (r.encoding, r.delimiter) for r in files.inspect_csv(spark, str(tmp_path)).collect()}
    assert seen == {"big.csv": ("utf-8", ";"), "all.csv": ("utf-8", "|")}
