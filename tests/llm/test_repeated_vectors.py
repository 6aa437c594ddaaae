"""Repeated rows of vectors against the registered SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallywright.llm import ann, queries


def test_repeated_rows_count_as_the_sql_counts_them(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(300)]
    rows += rows[15:30] + [rows[40]] * 3 + [(60, [1.0] * 8), (61, [9.0] * 8), (61, [9.0] * 8), (62, [0.0] * 8), (None, [1.0] * 8), (63, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, window=8, group_rows=40, block_queries=5).select("query_id", "rank", "vec_id", "score").collect()))
    con = duckdb.connect()
    table = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [None if r[1] is None else np.array(r[1], np.float32) for r in rows]})
    con.register("t", table)
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM t")
    want = sorted(con.execute(queries.ORACLE_SQL["op10_nearest_neighbours"]).fetchall())
    assert len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert sum(r[2] == 61 for r in want) >= 2
