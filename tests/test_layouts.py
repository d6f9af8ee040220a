"""Forms, tables and tables without a header, from approved plans to facts."""

import random

from pyspark.sql import functions as F

from granary.operators.layouts import form_selectors, materialize_plans

CELLS = "item_id string, sheet int, row int, col int, value string"
PLANS = "plan_id string, item_id string, supersedes_plan_id string"
REGIONS = "plan_id string, sheet int, region_id string, ordinal int, layout string, region_kind string, top int, left int, bottom int, right int, data_top int, data_bottom int, data_left int, data_right int, excluded array<int>, materialize boolean, template string, record_type string, identity array<string>"
MAPPINGS = "plan_id string, sheet int, region_id string, code string, role string, data_type string, required boolean, selector string, map_row int, map_col int"
HEADERS = "plan_id string, sheet int, region_id string, col int, header_path array<string>"

FORM = [["姓名", "张三", "性别", "男"], ["电话", "13800000000", "住址", "一组"]]
LIST = [["王五", 3], ["赵六", 5]]
FORM_FIELDS = [("person.name", 1, 2), ("person.sex", 1, 4), ("person.phone", 2, 2), ("household.address", 2, 4)]


def sheet(item, number, rows):
    return [(item, number, r + 1, c + 1, None if v is None else str(v)) for r, row in enumerate(rows) for c, v in enumerate(row)]


def region(plan, number, layout, box, ordinal=0, identity=(), excluded=(), materialize=True, kind="table", data=None, template="t@1"):
    return (plan, number, f"g{number}", ordinal, layout, kind, *box, *(data or (box[0], box[2], box[1], box[3])), list(excluded), materialize, template, "mixed", list(identity))


def tables(spark, cells, plans, regions, mappings, headers=()):
    return [spark.createDataFrame(list(x), s) for x, s in ((cells, CELLS), (plans, PLANS), (regions, REGIONS), (mappings, MAPPINGS), (headers, HEADERS))]


def test_form_and_headerless_table_keep_cell_lineage(spark):
    mappings = [("p", 0, "g0", c, None, "text", True, "cell", r, k) for c, r, k in FORM_FIELDS]
    mappings += [("p", 1, "g1", "person.name", "", "text", True, "physical_column", None, 1), ("p", 1, "g1", "task_count", "", "integer", True, "physical_column", None, 2)]
    regions = [region("p", 0, "form", (1, 1, 2, 4)), region("p", 1, "headerless_table", (1, 1, 2, 2), 1)]
    given = tables(spark, sheet("f", 0, FORM) + sheet("f", 1, LIST), [("p", "f", None)], regions, mappings)
    facts, plans = materialize_plans(*given)
    assert [tuple(x) for x in plans.collect()] == [("p", "completed", None, 3, 8, None)]
    assert sorted((r.record_id, r.source_row, r.mapping_status, r.quality_status) for r in facts.records.collect()) == [("p:s0:g0:r1", 1, "complete", "passed"), ("p:s1:g1:r1", 1, "complete", "passed"), ("p:s1:g1:r2", 2, "complete", "passed")]
    assert sorted((x.record_id, x.code, x.coordinate, x.raw_value, x.normalizer) for x in facts.lineage.collect()) == sorted(
        [("p:s0:g0:r1", c, "ABCD"[k - 1] + str(r), FORM[r - 1][k - 1], "text/v1") for c, r, k in FORM_FIELDS]
        + [(f"p:s1:g1:r{r}", "person.name", f"A{r}", LIST[r - 1][0], "text/v1") for r in (1, 2)] + [(f"p:s1:g1:r{r}", "task_count", f"B{r}", str(LIST[r - 1][1]), "integer/v1") for r in (1, 2)]
    )
    assert facts.values.agg(F.sum("integer_value")).first()[0] == 8
    # The same plan again makes the same rows; a plan that has run makes none.
    again, _ = materialize_plans(*given)
    for name in ("records", "values", "lineage", "issues"):
        a, b = getattr(facts, name), getattr(again, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    none, skipped = materialize_plans(*given, done=given[1].select("plan_id"))
    assert none.records.isEmpty() and skipped.first().status == "skipped"


def test_selectors_are_found_right_of_labels_or_below(spark):
    rows = [["姓名", "张三", "性别", "男", "备注"], ["电话", None, "住址", "一组", "都好"], ["家庭 情况", "签字", None, None, None], ["很好", None, None, None, None]]
    cells = spark.createDataFrame([("s", r, c, v) for _, _, r, c, v in sheet("f", 0, rows)], "sheet_id string, row int, col int, value string")
    regions = spark.createDataFrame([("s", "g", 1, 1, 4, 5)], "sheet_id string, region_id string, top int, left int, bottom int, right int")
    labels = spark.createDataFrame([("name", "姓名"), ("sex", "性别"), ("phone", "电话"), ("address", "住址"), ("note", "备注"), ("family", "家庭情况"), ("sign", "签字"), ("none", "没有")], "code string, label string")
    got = {x.code: (x.map_row, x.map_col) for x in form_selectors(cells, regions, labels).collect()}
    assert got == {"name": (1, 2), "sex": (1, 4), "phone": (2, 2), "address": (2, 4), "note": (2, 5), "family": (4, 1), "sign": (3, 3)}


PROBLEMS = [
    (dict(layout="pie"), "unknown_layout"), (dict(data=(0, 2, 1, 4)), "data_range_outside_region"), (dict(excluded=[9]), "data_range_outside_region"),
    (dict(layout="headerless_table"), "headerless_field_without_column"), (dict(layout="table"), "table_field_without_column"), (dict(data=(1, 1, 1, 4)), "form_cell_outside_range"),
    (dict(excluded=[2]), "form_cell_outside_range"), (None, "no_regions"),
]


def test_plans_that_cannot_be_materialized(spark):
    plans, regions, mappings = [("q", "f", "p0")], [region("q", 0, None, (1, 1, 2, 4), kind="form")], [("q", 0, "g0", "person.name", None, "text", True, "cell", 1, 2)]
    for i, (change, _) in enumerate(PROBLEMS):
        plans.append((f"p{i}", "f", None))
        if change is not None:
            regions.append(region(f"p{i}", 0, **({"layout": "form", "box": (1, 1, 2, 4)} | change)))
            mappings += [(f"p{i}", 0, "g0", c, None, "text", True, "cell", r, k) for c, r, k in FORM_FIELDS]
    facts, state = materialize_plans(*tables(spark, sheet("f", 0, FORM), plans, regions, mappings))
    assert {tuple(x) for x in state.collect()} == {("q", "completed", None, 1, 1, "p0")} | {(f"p{i}", "failed", problem, 0, 0, None) for i, (_, problem) in enumerate(PROBLEMS)}
    assert {x.plan_id for x in facts.records.collect()} == {"q"}


def test_roles_duplicates_and_a_field_twice(spark):
    rows = [["k", "a", "b"], ["x", "1", "2"], ["x", "3", ""], ["", "#N/A", "n"], ["y", "z", ""], ["合计", "", ""]]
    mappings = [("p", 0, "g0", "k", None, "text", True, None, None, 1), ("p", 0, "g0", "n", None, "integer", False, None, None, 2), ("p", 0, "g0", "n", "last", "integer", False, None, None, 3)]
    headers = [(p, 0, "g0", c + 1, [v]) for p in "pq" for c, v in enumerate(rows[0])]
    regions = [region(p, 0, "explicit_header_table", (1, 1, 6, 3), data=(2, 6, 1, 3), identity=["k"], excluded=[6]) for p in "pq"]
    twice = [("q", *m[1:4], None, *m[5:]) for m in mappings]
    facts, plans = materialize_plans(*tables(spark, sheet("f", 0, rows), [("p", "f", None), ("q", "f", None)], regions, mappings + twice, headers))
    assert {(x.plan_id, x.status, x.problem) for x in plans.collect()} == {("p", "partial", None), ("q", "failed", "field_twice_with_one_role")}
    assert sorted((x.record_id[-2:], x.code, x.detail) for x in facts.issues.collect()) == [
        ("r3", "duplicate_identity", "x"), ("r4", "incomplete_identity", "k"), ("r4", "normalization_failed", "n@C4"), ("r4", "required_missing", "k"), ("r5", "normalization_failed", "n@B5"),
    ]
    assert {(x.record_id[-2:], x.code, x.role, x.integer_value) for x in facts.values.filter("code = 'n'").collect()} == {("r2", "n", "", 1), ("r2", "n", "last", 2), ("r3", "n", "", 3), ("r4", "n", "", None)}


def test_many_plans_match_a_plain_loop(spark):
    r = random.Random(4)
    cells, plans, regions, mappings, headers, want = [], [], [], [], [], set()
    for i in range(40):
        grid = [[r.choice(["", None, "7", "x", "12"]) for _ in range(4)] for _ in range(6)]
        cells += sheet(f"f{i}", 0, grid)
        p, layout = f"p{i}", r.choice(["form", "headerless_table", "table"])
        plans.append((p, f"f{i}", None))
        out = sorted(r.sample(range(2, 6), r.randrange(2)))
        regions.append(region(p, 0, layout, (1, 1, 6, 4), data=(2, 6, 1, 4), excluded=out))
        headers += [(p, 0, "g0", c, [f"h{c}"] if c != 3 else []) for c in range(1, 5)]
        own = [(f"c{c}", 6, c) for c in (1, 2, 4)]
        mappings += [(p, 0, "g0", code, None, "text", c == 1, "cell" if layout == "form" else "physical_column", row if layout == "form" else None, c) for code, row, c in own]
        full = lambda x: bool(x and x.strip())
        data = {row: grid[row - 1] for row in range(2, 7) if row not in out}
        if layout == "form":
            if any(full(v) for row in data.values() for v in row):
                want |= {(f"{p}:s0:g0:r2", code, grid[row - 1][c - 1]) for code, row, c in own if full(grid[row - 1][c - 1])} | {(f"{p}:s0:g0:r2", None, "passed" if full(grid[5][0]) else "failed")}
            continue
        for row, v in data.items():
            held = {(code, v[c - 1]) for code, _, c in own if full(v[c - 1])}
            if held:
                want |= {(f"{p}:s0:g0:r{row}", *h) for h in held} | {(f"{p}:s0:g0:r{row}", None, "passed" if full(v[0]) else "failed")}
    facts, _ = materialize_plans(*tables(spark, cells, plans, regions, mappings, headers))
    got = {(x.record_id, x.code, x.text_value) for x in facts.values.collect()} | {(x.record_id, None, x.quality_status) for x in facts.records.collect()}
    assert got == want


def test_cells_meet_their_regions_once(spark):
    """Read off the plan: values come from what was written, less the plans with a field twice, and join nothing else."""
    given = tables(spark, sheet("f", 0, LIST), [("p", "f", None)], [region("p", 0, "headerless_table", (1, 1, 2, 2))], [("p", 0, "g0", "n", None, "integer", True, "physical_column", None, 2)])
    facts, _ = materialize_plans(*given)
    assert facts.values._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 1
    assert sorted((v.record_id, v.integer_value) for v in facts.values.collect()) == [("p:s0:g0:r1", 3), ("p:s0:g0:r2", 5)]
