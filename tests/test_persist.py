"""Stored suggestions: runs, review items and status changes, worked out by hand."""

from ledgerloom.operators import consolidate as K
from ledgerloom.operators import persist as P

from .test_recurrence import CONSOLIDATED, suggestion

STORED = CONSOLIDATED + ", status string, approved boolean, dedup_key string"


def stored(row, status, approved=False, key=None):
    return (*row, status, approved, key or f"key-{row[0]}")


def after(spark, found, old):
    state = P.persisted(spark.createDataFrame(found, CONSOLIDATED), spark.createDataFrame(old, STORED))
    return {r.id: r for r in state.collect()}


def test_a_new_one_is_stored_under_its_key(spark):
    found = [suggestion("n1", ["1", "2", "3"])]
    (made,) = after(spark, found, []).values()
    base = K.described(spark.createDataFrame(found, CONSOLIDATED)).select(K.logical_key(None).alias("k")).first().k
    assert (made.change, made.status, made.dedup_key) == ("created", "pending", base)
    other = stored(suggestion("o1", ["7"], text="internet fibra", amount=-900.0), "rejected", key=base)
    both = after(spark, found, [other])
    assert both["n1"].dedup_key == f"{base}:n1" and both["o1"].change is None


def test_the_approved_one_stands_for_its_equals(spark):
    old = [stored(suggestion("a", ["1", "2"], 60), "approved", True), stored(suggestion("b", ["1", "2", "3"], 90), "pending"), stored(suggestion("c", ["1", "2", "3"], 95), "edited")]
    found = after(spark, [suggestion("n", ["2", "3", "4"], 99)], old)
    assert {i: (r.status, r.change) for i, r in found.items()} == {"a": ("approved", None), "b": ("superseded", "superseded"), "c": ("edited", None)}
    assert found["a"].transaction_ids == ["1", "2", "3", "4"] and found["a"].confidence == 60


def test_a_superseded_one_waits_again_and_a_better_run_refreshes(spark):
    found = after(spark, [suggestion("n", ["1", "2", "3", "4"], 80)], [stored(suggestion("a", ["1", "2", "3"], 80), "superseded")])
    assert (found["a"].status, found["a"].change, found["a"].transaction_ids) == ("pending", "reactivated", ["1", "2", "3", "4"])
    found = after(spark, [suggestion("n", ["1", "2", "3"], 90), suggestion("m", ["1", "2", "5"], 85)], [stored(suggestion("a", ["1", "2", "3"], 80), "pending")])
    assert (found["a"].confidence, found["a"].change, found["a"].transaction_ids) == (90, "refreshed", ["1", "2", "3", "5"]) and set(found) == {"a"}
    found = after(spark, [suggestion("n", ["1", "2", "3"], 70)], [stored(suggestion("a", ["1", "2", "3"], 80), "pending")])
    assert (found["a"].confidence, found["a"].change) == (80, None)
    assert after(spark, [], [stored(suggestion("a", ["1"]), "pending")])["a"].change is None


def test_review_items_follow_the_state(spark):
    state = spark.createDataFrame([stored(suggestion(i, ["1"], c), s) for i, c, s in (("a", 90, "pending"), ("b", 70, "edited"), ("c", 70, "approved"), ("d", 70, "pending"))], STORED)
    items = spark.createDataFrame([("c", "c", "medium", "open", "k1"), ("d", "c", "medium", "in_review", "k2"), ("b", "c", "high", "dismissed", "k3")], "suggestion_id string, company_id string, severity string, status string, dedup_key string")
    found = sorted(map(tuple, P.approval_items(state, items).collect()))
    assert found == sorted([("a", "c", "high", "open", "c:recurrence_approval:a"), ("b", "c", "medium", "open", "c:recurrence_approval:b"), ("b", "c", "high", "dismissed", "k3"), ("c", "c", "medium", "dismissed", "k1"), ("d", "c", "medium", "in_review", "k2")])


def test_status_changes_of_approved(spark):
    approved = spark.createDataFrame([("c", "r1", "s1", "active"), ("c", "r2", None, "active"), ("x", "r1", "s9", "active")], "company_id string, id string, suggestion_id string, status string")
    suggestions = spark.createDataFrame([("c", "s1", "approved"), ("x", "s1", "approved")], "company_id string, id string, status string")
    changes = spark.createDataFrame([("c", "r1", "rejected", "u", "why"), ("c", "r2", "paused", "u", None), ("c", "r9", "paused", "u", None)], "company_id string, id string, status string, actor string, reason string")
    now, told, audit = P.change_approved(approved, suggestions, changes)
    assert sorted(map(tuple, now.select("company_id", "id", "status").collect())) == [("c", "r1", "rejected"), ("c", "r2", "paused"), ("x", "r1", "active")]
    assert sorted(map(tuple, told.collect())) == [("c", "s1", "rejected"), ("x", "s1", "approved")]
    assert sorted((r.id, r.previous, r.next, r.error) for r in audit.collect()) == [("r1", "active", "rejected", None), ("r2", "active", "paused", None), ("r9", None, "paused", "not_found")]
