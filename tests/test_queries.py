"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from tallywright.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ("apply_recipe", "quarantine", "column_profile", "temporal_check", "classification_metrics", "group_folds", "selection_decision", "forecast_future_sums", "live_state", "boxplots", "regression_metrics", "baseline_median", "scan_csv", "write_prepared", "missing_months", "curve_shape", "parse_number_comma", "even_sample")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(columns), sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert comparable(df.columns, df.collect()) == comparable(columns, want.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.series_id for r in rows} >= {"total"} and len(rows) % 6 == 0


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
