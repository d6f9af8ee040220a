"""Supersession declarations and version transitions."""

import pytest

from granary.plans.lifecycle import ends_of_chains, supersession_problems, transition


def test_supersession(spark):
    items = spark.createDataFrame([(i, u, t) for i, u, t in [("a", "u", 1), ("b", "u", 2), ("c", "u", 3), ("d", "v", 9), ("e", "u", 0), ("f", "u", 5), ("g", "w", 5), ("h", "u", 2)]], "item_id string, unit_id string, created_at int")
    records = spark.createDataFrame([(i, "passed") for i in "abcdegh"] + [("f", "failed")], "item_id string, quality_status string")
    declared = spark.createDataFrame([("a", "b"), ("b", "c")], "old_id string, new_id string")
    wanted = [("a", "a"), ("a", "zz"), ("b", "g"), ("c", "d"), ("c", "e"), ("c", "f"), ("a", "c"), ("e", "c"), ("e", "h"), ("h", "b")]
    got = {(r.old_id, r.new_id): r.problem for r in supersession_problems(items, records, declared, spark.createDataFrame(wanted, declared.schema), ["u", "v"]).collect()}
    assert got == {("a", "a"): "self", ("a", "zz"): "unknown_item", ("b", "g"): "outside_scope", ("c", "d"): "other_unit", ("c", "e"): "older", ("c", "f"): "no_passed_records", ("a", "c"): "already_declared", ("e", "c"): None, ("e", "h"): "already_declared", ("h", "b"): None}
    same = spark.createDataFrame([("c", "u", 1), ("a", "u", 1), ("b", "u", 1)], items.schema)
    assert supersession_problems(same, records, declared, spark.createDataFrame([("c", "a")], declared.schema), ["u"]).first().problem == "cycle"
    with pytest.raises(ValueError, match="cycle"):
        ends_of_chains(spark.createDataFrame([("x", "y"), ("y", "x")], declared.schema), rounds=3)


def test_transitions(spark):
    versions = spark.createDataFrame([("t", 1, "published"), ("t", 2, "admin_review"), ("s", 1, "draft"), ("r", 1, "admin_review"), ("q", 1, "admin_review"), ("p", 1, "published")], "code string, version int, status string")
    asked = spark.createDataFrame([("t", 2, "approve", None), ("s", 1, "approve", None), ("r", 1, "reject", " "), ("q", 1, "approve", ""), ("p", 1, "deprecate", ""), ("z", 1, "confirm", ""), ("s", 9, "dance", "")], "code string, version int, action string, comment string")
    after, events = transition(versions, asked, spark.createDataFrame([("q", 1)], "code string, version int"))
    assert {(r.code, r.version): r.status for r in after.collect()} == {("t", 1): "deprecated", ("t", 2): "published", ("s", 1): "draft", ("r", 1): "admin_review", ("q", 1): "admin_review", ("p", 1): "deprecated"}
    assert {(r.code, r.action): r.problem for r in events.collect()} == {("t", "approve"): None, ("s", "approve"): "wrong_state", ("r", "reject"): "comment_missing", ("q", "approve"): "fields_unpublished", ("p", "deprecate"): None, ("z", "confirm"): "unknown_version", ("s", "dance"): "unknown_action"}
