"""Approval of plans: first problems, ranges that overlap, and what is reused."""

import random

from granary.plans.approval import approve, merged_decisions, overlapping

RANGE = "data_top int, data_bottom int, data_left int, data_right int"
REGION = f"plan_id string, item_id string, region_id string, header_id string, origin string, materialize boolean, {RANGE}, sheet string"


def test_overlaps_match_a_loop_over_cells(spark):
    r = random.Random(6)
    rows = []
    for p in range(60):
        for g in range(r.randrange(1, 6)):
            top, left = r.randrange(12), r.randrange(12)
            rows.append((f"p{p}", r.choice(["s", "t"]), f"g{g}", top, top + r.randrange(4), left, left + r.randrange(4)))
    want = set()
    for p in {x[0] for x in rows}:
        seen = set()
        for _, s, _, top, bottom, left, right in (x for x in rows if x[0] == p):
            cells = {(s, i, j) for i in range(top, bottom + 1) for j in range(left, right + 1)}
            if cells & seen:
                want.add(p)
            seen |= cells
    got = {x.plan_id for x in overlapping(spark.createDataFrame(rows, f"plan_id string, sheet string, region_id string, {RANGE}")).collect()}
    assert got == want and 0 < len(want) < 60


def test_reused_new_and_open_regions(spark):
    matches = [("f", "g1", "h1", "exact", None, 1, 5, 1, 3), ("f", "g2", "h2", "partial", None, 7, 9, 1, 3), ("f", "g3", "h3", "none", None, 11, 12, 1, 3)]
    decided = [("p", "f", "g1", "other", True, 1, 1, 1, 1), ("p", "f", "g2", "h2", True, 8, 9, 1, 3)]
    got = merged_decisions(
        spark.createDataFrame(matches, f"item_id string, region_id string, header_id string, match_type string, materialize boolean, {RANGE}"),
        spark.createDataFrame(decided, f"plan_id string, item_id string, region_id string, header_id string, materialize boolean, {RANGE}"),
    )
    assert {(x.region_id, x.header_id, x.origin, x.materialize, x.data_top) for x in got.collect()} == {("g1", "h1", "reused", True, 1), ("g2", "h2", "new", True, 8), ("g3", "h3", "open", False, 11)}


def test_first_problems(spark):
    """One request for each rule; what it breaks, and nothing before it."""
    base = {"item_id": "f", "source": "template", "template_id": "t", "template_version": 1, "proposal_id": None, "supersedes": None, "digest": "d"}
    hybrid = {"source": "provisional", "template_id": "v", "proposal_id": "o"}
    cases = {
        "ok": ({}, None), "no_item": ({"item_id": "?"}, "unknown_item"), "gone": ({"item_id": "gone"}, "item_deleted"), "source": ({"source": "guess"}, "unknown_source"), "blind": ({"item_id": "blind"}, "evidence_missing"),
        "draft": ({"template_version": 2}, "template_unavailable"), "status": ({"source": "proposed"}, "template_unavailable"), "hybrid": (hybrid, None), "foreign": (hybrid | {"item_id": "g"}, "proposal_of_other_file"),
        "decided": (hybrid | {"proposal_id": "accepted", "template_id": "w"}, "proposal_in_other_state"), "extra": ({"proposal_id": "o"}, "proposal_not_allowed"), "short": ({}, "regions_differ"), "old": (hybrid, "nothing_new"),
        "open": ({}, "regions_open"), "header": ({}, "header_of_other_region"), "cross": ({}, "ranges_overlap"), "same": ({"item_id": "had"}, "unchanged"), "loose": ({"item_id": "had", "digest": "e"}, "latest_not_superseded"),
        "next": ({"item_id": "had", "digest": "e", "supersedes": "had2"}, None), "done": ({"item_id": "done", "digest": "e", "supersedes": "done1"}, "latest_completed"), "void": ({"supersedes": "x"}, "nothing_to_supersede"),
        "confirmed": ({"item_id": "prov", "source": "proposed", "template_id": "u", "proposal_id": "a", "supersedes": "prov1"}, None),
    }
    requests = [(name, *[(base | c)[k] for k in base]) for name, (c, _) in cases.items()]
    items = [(i, i != "gone", None if i == "blind" else 2) for i in ("f", "g", "gone", "blind", "had", "done", "prov")]
    templates = [("t", 1, "published", False, None), ("t", 2, "draft", False, None), ("v", 1, "admin_review", False, "o"), ("w", 1, "admin_review", False, "accepted"), ("u", 1, "user_confirmed", False, "a")]
    proposals = [("o", "f", "pending", False), ("accepted", "f", "accepted", False), ("a", "prov", "accepted", False)]
    regions = []
    for name, (c, _) in cases.items():
        second = {"open": "open", "old": "reused"}.get(name, "new" if "provisional" in c.values() else "reused")
        regions.append((name, "f", "g1", "h1", "reused", True, 1, 4, 1, 3, "s"))
        if name != "short":
            regions.append((name, "f", "g2", "h1" if name == "header" else "h2", second, second != "open", 4 if name == "cross" else 5, 9, 3, 6, "s"))
    approved = [("had1", "had", 1, "template", "t", 1, None, "x", "completed"), ("had2", "had", 2, "template", "t", 1, None, "d", "partial"), ("done1", "done", 1, "template", "t", 1, None, "d", "completed"), ("prov1", "prov", 1, "provisional", "u", 1, "a", "d", "completed")]
    got = approve(
        spark.createDataFrame(requests, "plan_id string, item_id string, source string, template_id string, template_version int, proposal_id string, supersedes string, digest string"),
        spark.createDataFrame(items, "item_id string, active boolean, total_regions int"),
        spark.createDataFrame(templates, "template_id string, version int, status string, retired boolean, proposal_id string"),
        spark.createDataFrame(proposals, "proposal_id string, item_id string, status string, retired boolean"),
        spark.createDataFrame(regions, REGION), spark.createDataFrame([("g1", "h1"), ("g2", "h2")], "region_id string, header_id string"),
        spark.createDataFrame(approved, "plan_id string, item_id string, revision int, source string, template_id string, template_version int, proposal_id string, digest string, status string"),
    )
    found = {x.plan_id: x for x in got.collect()}
    assert {k: x.problem for k, x in found.items()} == {k: p for k, (_, p) in cases.items()}
    assert (found["ok"].revision, found["next"].revision, found["same"].revision, found["confirmed"].revision, found["open"].revision) == (1, 3, 2, 2, None)
