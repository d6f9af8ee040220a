"""Header semantics, field scoring, layout projection and question classes on literal cases."""

import re

from pyspark.sql import functions as F

from granary.functions import headers as H
from granary.operators import fields, questions


def of(spark, column, rows, schema="path array<string>"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column(F.col(schema.split()[0])).alias("v")).orderBy("i").collect()]


def test_label_keys(spark):
    assert of(spark, H.label_key, ["姓 名（人）", "ＡＢＣ-１２", "Straße", None, "，。"], "t string") == ["姓名人", "abc12", "strasse", None, ""]


def test_semantic_paths(spark):
    rows = [["户主 姓名"], ["张家村", "面积"], ["2023", "金额"], ["某某有限公司"], [], None, ["男"], ["5月"], ["2023年5月"], ["a/1"], ["", " 电话 "], ["x", None]]
    want = [["户主 姓名"], ["面积"], ["金额"], [], [], [], [], ["5月"], [], [], ["电话"], ["x"]]
    assert of(spark, H.semantic_path, rows) == want


def test_semantics(spark):
    rows = [["户主姓名"], ["户主", "姓名"], ["配偶", "身份证号码"], ["手机号"], ["土地", "面积（万亩）"], ["账户姓名"], ["监护人联系电话"], ["某某明细", "金额"], [], ["联系人"], ["户主（实际）"]]
    got = [(r.base_label, r.concept, r.role, r.role_evidence, r.qualifier) for r in of(spark, H.header_semantics, rows)]
    assert got == [
        ("姓名", "person.name", "household_head", "户主姓名", None), ("姓名", "person.name", "household_head", "户主", None), ("身份证号", "person.identity_number", "spouse", "配偶", None),
        ("联系电话", "person.phone", None, None, None), ("面积", None, None, None, "土地"), ("姓名", "person.name", "account_holder", "账户姓名", None),
        ("联系电话", "person.phone", "guardian", "监护人联系电话", None), ("金额", None, None, None, None), ("", None, None, None, None), ("姓名", "person.name", "contact", "联系人", None),
        ("姓名", "person.name", "household_head", "户主(实际)", None),
    ]


def test_labels_paths_and_roles(spark):
    assert of(spark, H.equivalent_labels, ["手机号", "备注"], "t string") == [sorted(["联系电话", "联系方式", "电话", "手机号", "手机号码", "电话号码"]), ["备注"]]
    assert of(spark, H.role_code, ["户主", "head", "Duplicate 3", "as of 2024-01-02", "zzz", None, "spouse"], "t string") == ["household_head", "household_head", "duplicate_3", "date_2024_01_02", None, None, "spouse"]
    pairs = [(["a", "b"], [" a ", "b"], True), (["登记表", "b"], ["b"], True), (["x", "b"], ["b"], False), (["统计", "b"], ["b"], True), (["花名册", "a", "b"], ["b"], True), (["a"], ["b"], False), ([], ["b"], False)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>, want boolean")
    assert [r.got for r in df.select(H.paths_equivalent(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]
    sets = [[["登记表", "a"], ["登记表", "b", "c"]], [["x", "a"], ["x", "b"]], [["a"], ["登记表", "a"]], [], [["登记表", "甲", "a"], ["登记表", "甲", "b"]]]
    assert of(spark, H.header_set, sets, "p array<array<string>>") == [["a", "b / c"], ["x / a", "x / b"], ["a", "登记表 / a"], [], ["a", "b"]]


def catalog(spark):
    f = spark.createDataFrame([("name", 2, "text", ["姓名"]), ("area", 1, "decimal", ["承包面积"]), ("phone", 1, "text", ["电话", None]), ("bare", 1, "text", None)], "code string, version int, data_type string, labels array<string>")
    b = spark.createDataFrame([("name", ["户主", "姓名"], "pop", "person", "户主"), ("area", ["土地", "面积"], "land", "plot", None), ("gone", ["x"], "a", "b", None)], "code string, path array<string>, domain string, record_type string, role string")
    return fields.field_catalog(f, b)


def test_catalog(spark):
    got = {r.code: r for r in catalog(spark).collect()}
    assert got["name"].full_paths == ["户主姓名"] and got["name"].roles == ["household_head"] and [tuple(c) for c in got["name"].contexts] == [("pop", "person")] and "农户姓名" in got["name"].aliases
    assert got["area"].aliases == ["承包面积", "面积"] and got["bare"].aliases == [] and set(got) == {"name", "area", "phone", "bare"}


def test_scores_and_choice(spark):
    cols = [("c1", ["户主", "姓名"], "text", "pop", "person"), ("c2", ["承包面积（万亩）"], "integer", "land", "plot"), ("c3", ["联系电话"], "text", "x", "y"), ("c4", ["实际承包面积大小"], "text", None, None), ("c5", ["完全无关"], None, None, None)]
    df = spark.createDataFrame(cols, "column_id string, path array<string>, observed_type string, domain string, record_type string")
    got = {r.column_id: r for r in fields.choose_fields(fields.score_fields(df, catalog(spark))).collect()}
    assert (got["c1"].code, got["c1"].score, got["c1"].exact) == ("name", 10_000, True) and got["c1"].candidates[0].reasons == ["full_header_path", "data_type", "region_context", "role"]
    assert (got["c2"].code, got["c2"].score, got["c2"].exact) == ("area", 7500, False) and got["c2"].candidates[0].reasons[0] == "normalized_base_alias"
    assert (got["c3"].code, got["c3"].score, got["c3"].exact) == ("phone", 5500, False)
    assert (got["c4"].code, got["c4"].score) == ("area", 3500) and "c5" not in got


def test_match_order(spark):
    cols = [("c0", ["", None], None, "d", "r", "t"), ("c1", ["面积"], "text", "d", "r", "t"), ("c2", ["备注"], "text", "d", "r", "t"), ("c3", ["户主", "姓名"], "text", "pop", "person", None), ("c4", ["zz"], None, None, None, None), ("c5", ["备注"], "integer", "d", "r", "u")]
    df = spark.createDataFrame(cols, "column_id string, path array<string>, observed_type string, domain string, record_type string, template_id string")
    bound = spark.createDataFrame([("t", "面积", "area", 1)], "template_id string, path_key string, code string, version int")
    ignored = spark.createDataFrame([("备注", "d", "r", "text")], "path_key string, domain string, record_type string, observed_type string")
    got = {r.column_id: (r.code, r.score, r.matched_by) for r in fields.match_fields(df, catalog(spark), bound, ignored).collect()}
    assert got == {"c0": (None, 10_000, "auxiliary_column"), "c1": ("area", 10_000, "template_binding"), "c2": (None, 10_000, "ignore_rule"), "c3": ("name", 10_000, "scored_exact"), "c4": (None, 0, "none"), "c5": (None, 0, "none")}


def test_types_slots_and_bags(spark):
    assert of(spark, fields.observed_type, [[], ["integer"], ["integer", "decimal"], ["text", "date"], ["date"]], "k array<string>") == [None, "integer", "decimal", "text", "date"]
    slots = spark.createDataFrame([("t", "a", True), ("t", "b", True), ("u", "c", False), ("w", "d", True)], "template_id string, slot_key string, required boolean")
    actual = spark.createDataFrame([("t", "r1"), ("v", "r2")], "template_id string, source_id string")
    assert sorted(tuple(r) for r in fields.slot_coverage(slots, actual).fillna("").collect()) == [("t", "a", "r1", "filled"), ("t", "b", "", "missing"), ("u", "c", "", "optional"), ("v", "", "r2", "left_over"), ("w", "d", "", "missing")]
    l = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a")], "left_id string, code string")
    assert [tuple(r) for r in fields.same_fields(l, l.withColumnRenamed("left_id", "right_id").filter("right_id = 'x'")).collect()] == [("x", "x")]


def test_pairs_of_one_bag_are_spread_over_tasks(spark):
    """Every left owner has the bag of every right one, but for some; blocks are cut, and no task makes all pairs."""
    both = F.explode(F.array(F.lit("b"), F.lit("a"))).alias("code")
    l = spark.range(700).select(F.nullif("id", F.lit(5)).alias("left_id"), both)
    r = spark.range(5000).select(F.col("id").alias("right_id"), both).unionByName(spark.createDataFrame([(-1, "a"), (-2, "a"), (-2, "a"), (-2, "b")], "right_id long, code string"))
    got = fields.same_fields(l, r)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(t["count"] for t in tasks) == 700 * 5000
    assert len(tasks) > 8 and max(t["count"] for t in tasks) < 700 * 5000 / 4
    held = got.groupBy("left_id").agg(F.countDistinct("right_id").alias("n"), F.min("right_id").alias("least"), F.max("right_id").alias("most")).collect()
    assert len(held) == 700 and None in {h["left_id"] for h in held} and {(h["n"], h["least"], h["most"]) for h in held} == {(5000, 0, 4999)}


def test_pairs_are_not_held_before_they_go_on(spark):
    """Spark keeps all rows of a compiled loop until it ends, so no generator shares its loop with a join or with another generator."""
    l = spark.range(600).select(F.col("id").alias("left_id"), F.lit("a").alias("code"))
    got = fields.same_fields(l, l.withColumnRenamed("left_id", "right_id"))
    assert len(got.collect()) == 600 * 600
    plan = got._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    loops = [n for n, node in re.findall(r"\*\((\d+)\) (Generate|\w*Join)", plan)]
    assert len(loops) == 4 and len(set(loops)) == 4, plan


def test_pairs_of_cut_blocks_and_of_bare_owners(spark, monkeypatch):
    """Blocks, groups and tasks of every size make each pair once; owners whose fields are all NULL have none, as in SQL."""
    rows = [(i, c) for i in range(90) for c in ("a", "b", None)[: 1 + i % 3]] + [(None, "a"), (200, None), (201, None)]
    l = spark.createDataFrame(rows, "left_id long, code string")
    assert fields.same_fields(l.filter("left_id = 200"), l.withColumnRenamed("left_id", "right_id")).collect() == []
    bags = {}
    for i, c in rows:
        bags.setdefault(i, []).extend([c] if c else [])
    want = sorted(((i, j) for i in bags for j in bags if bags[i] and sorted(bags[i]) == sorted(bags[j])), key=str)
    for deals, block, blocks, pairs, tasks in ((1, 2, 3, 1, (1, 5)), (2, 3, 2, 10, (2, 50)), (16, 256, 16, 1 << 26, (4, 8))):
        for name, value in zip(("DEALS", "BLOCK", "BLOCKS", "PAIRS", "TASKS"), (deals, block, blocks, pairs, tasks), strict=True):
            monkeypatch.setattr(fields, name, value, raising=False)
        got = fields.same_fields(l, l.withColumnRenamed("left_id", "right_id"))
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_projection(spark):
    schema = "sheet int, signature string, top int, bottom int, left int, right int, header_end int, data_start int, data_end int, data_left int, data_right int, excluded array<int>"
    snap = fields.layout_snapshot(spark.createDataFrame([(0, "s", 1, 20, 1, 5, 2, 4, 18, 2, 5, [6]), (0, "bad", 1, 5, 1, 2, 1, 2, 9, 1, 2, [])], schema))
    heads = spark.createDataFrame([("w1", 0, "s", 3, 50, 2, 6, 4), ("w2", 0, "s", 1, 4, 1, 5, 2), ("w3", 0, "s", 1, 9, 1, 5, 2), ("w3", 0, "s", 11, 30, 1, 5, 12)], "workbook_id string, sheet int, signature string, top int, bottom int, left int, right int, header_end int")
    got = sorted((r.workbook_id, r.data_start, r.data_end, r.data_left, r.data_right, r.excluded, r.state) for r in fields.project_layout(snap, heads).collect())
    assert got[:2] == [("w1", 6, 48, 3, 6, [8], "projected"), ("w2", 4, 2, 2, 5, [6], "invalid_range")] and {g[-1] for g in got[2:]} == {"ambiguous_header"}


def test_question_classes(spark):
    cases = [(1, "全村党员有多少", []), (2, "此人多大", []), (3, "预测明年收入", []), (4, "有多少面积", ["不存在的文件"]), (5, "面积环比", []), (6, "姓名总金额是", []), (7, "面积有多少", ["土地台账"]), (8, "电话名单", ["某村人口清册"]), (9, "身份证是什么", []), (10, "面积", ["人口清册"]), (11, "电话", ["土地台账"])]
    df = spark.createDataFrame(cases, "case_id int, question string, reference_keys array<string>")
    terms = spark.createDataFrame([("area", "面积", "decimal"), ("name", "姓名", "text"), ("phone", "电话", "text")], "code string, term string, data_type string")
    known = spark.createDataFrame([("土地台账2024", "area", True, "f1"), ("人口清册", "phone", False, "f2"), ("人口清册", "area", False, "f2"), ("人口清册", "area", False, "f3")], "source_key string, code string, queryable boolean, fact_set_key string")
    got = {r.case_id: (r.category, r.reference) for r in questions.classify(df, terms, known, True).collect()}
    assert got == {
        1: ("semantic_assessment_required", "not_specified"), 2: ("should_clarify", "not_specified"), 3: ("should_refuse", "not_specified"), 4: ("data_not_ingested", "unmatched"),
        5: ("semantic_assessment_required", "not_specified"), 6: ("semantic_assessment_required", "not_specified"), 7: ("governed_executable", "matched"), 8: ("should_clarify", "matched"),
        9: ("sensitive_permission_blocked", "not_specified"), 10: ("should_clarify", "matched"), 11: ("semantic_assessment_required", "matched"),
    }
