from __future__ import annotations

from tallywright.operators import tables


def test_only_listed_fields_leave(spark):
    one = lambda **v: tables.one_row(spark, **v)
    given = {
        "candidates": one(candidate_id="ridge", primary_value=1.5, status="completed", wins=3, secret="x"),
        "decision": one(selected_id="ridge", passing=1, secret="x"),
        "confirmation": one(confirmed=True, wins=2, rows_seen="x"),
        "plan": one(plan_sha256="ab", population_count=9, path="x"),
        "columns": one(position=0, column_name="a", kind="text"),
        "rows": one(cell="x"),
    }
    full = {k: v.columns for k, v in tables.share_projection(given, level=2).items()}
    assert full == {"candidates": ["candidate_id", "primary_value", "status", "wins"], "decision": ["selected_id", "passing"], "confirmation": ["confirmed", "wins"], "plan": ["plan_sha256", "population_count"], "columns": ["position", "column_name", "kind"]}
    brief = tables.share_projection(given, detail="summary")
    assert brief["candidates"].columns == ["candidate_id", "primary_value", "status"]
    assert brief["columns"].columns == ["position", "kind"]
