"""F8: every benchmark item is looked for, not only the first of those that share a template."""

from __future__ import annotations

from tallywright.llm import decontam

ITEM = "A train leaves {} at 30 km per hour and {} is 90 km away. How long does the train need to reach the town?"
DOC, BENCH = "doc_id long, text string", "item_id long, text string"


def found(spark, docs, items):
    got = decontam.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, BENCH)).collect()
    return sorted((r.doc_id, r.item_id, r.n_items, r.kind) for r in got)


def test_items_of_one_template_with_other_equal_values_are_looked_for(spark):
    items = [(1, ITEM.format("Paris", "Paris")), (2, ITEM.format("Paris", "Rome"))]
    docs = [(0, items[0][1]), (1, items[1][1]), (2, ITEM.format("Lyon", "Oslo")), (3, "Nothing of the kind was ever told in this place.")]
    # one value may stand for two, not two for one: document 0 holds both templates, 1 and 2 the second only
    assert found(spark, docs, items) == [(0, 1, 1, "exact"), (0, 2, 1, "reparameterised"), (1, 2, 1, "exact"), (2, 2, 1, "reparameterised")]


def test_the_values_of_any_item_of_a_class_are_exact(spark):
    items = [(k, ITEM.format(a, b)) for k, (a, b) in enumerate((("Paris", "Rome"), ("Oslo", "Rome"), ("Lyon", "Bern")))]
    docs = [*items, (7, ITEM.format("Paris", "Bern")), (8, ITEM.format("Lyon", "Bern") + " Nobody knew.")]
    assert found(spark, docs, items) == [(0, 0, 3, "exact"), (1, 0, 3, "exact"), (2, 0, 3, "exact"), (7, 0, 3, "reparameterised"), (8, 0, 3, "exact")]


def test_an_item_without_an_id_hides_none(spark):
    items = [(None, ITEM.format("Paris", "Rome")), (5, ITEM.format("Paris", "Rome")), (None, "Which of the old mills near the river was built before the bridge?")]
    docs = [(0, items[0][1]), (1, items[2][1]), (2, "So it was.")]
    got = decontam.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, BENCH)).collect()
    assert {(r.doc_id, r.item_id, r.kind) for r in got} == {(0, 5, "exact"), (1, None, "exact")}
    kept = decontam.remove_contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, BENCH)).collect()
    assert [r.doc_id for r in kept] == [2]
