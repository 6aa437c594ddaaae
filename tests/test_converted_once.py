"""Converted cells are written once; results that need them don't convert again."""

from __future__ import annotations

from tallywright.operators import recipe


def test_results_of_a_recipe_read_what_was_converted_once(spark):
    rows = [(k, f" {k},5 " if k % 3 else "n/a") for k in range(12)]
    rule = recipe.ColumnRule("amount", "numeric", decimal=",", invalid="segregate")
    done = recipe.apply_recipe(spark.createDataFrame(rows, "id long, amount string"), recipe.Recipe(columns=(rule,), filters=(recipe.NumericNotNull("amount"),)), "id")
    for df in (done.data, done.quarantine, done.log, done.changes):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, done.data.collect())) == [(k, k + 0.5) for k in range(12) if k % 3]
    assert sorted(r.row_id for r in done.quarantine.collect()) == [0, 3, 6, 9]
