"""Stores, frozen scopes, catalogs, contract tables, guarded SQL with evidence, on small sets with known answers."""

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.operators.listing import suffixed_roles
from granary.operators.materialize import excluded_rows, fact_set, materialize, raw_rows
from granary.plans import scoping
from granary.plans.answers import Catalog, Safe, aggregate_records, lookup_records, metric, safe, safe_with_evidence, serialized
from granary.plans.contracts import Filter, Measure, Provenance, QueryError, Scope
from granary.plans.governance import publish_metrics, run_metric
from granary.plans.guarded_sql import ask
from granary.plans.guarded_sql import run as guarded
from granary.plans.lookup import source_fields, source_rows
from granary.sources import store
from granary.sources.facts import wide
from tests.test_materialized import ITEMS, cells_and_maps

UNITS = ("v1", "v2")


@pytest.fixture(scope="module")
def villages(spark):
    """Two villages that count 7 and 5 persons, and a record of another template."""
    rows = [("1", 7, "v1", "f1", "2024-01-01", "passed", "p1"), ("2", 5, "v2", "f2", "2024-01-03", "passed", "p1"), ("99", 99, "v1", "f1", "2024-01-01", "passed", "p2"), ("3", 1000, "v1", "f3", "2024-01-01", "failed", "p1")]
    df = spark.createDataFrame(rows, "id string, persons int, unit string, item string, at string, quality string, plan string")
    facts = wide(
        df, "person", F.col("id"), {"count": ("integer", F.col("persons"))}, F.col("unit"), F.col("item"), F.col("at"), F.col("quality"), row=F.col("id"), dimensions=("person.count",),
        measures={"person.count": Measure(("sum",))}, units=spark.createDataFrame([("v1", "North"), ("v2", "South")], "unit_id string, name string"),
    )
    plans = df.select(F.concat(F.lit("person:"), "id").alias("record_id"), "plan")
    return replace(facts, df=facts.df.join(plans, "record_id").withColumn("approved_plan_id", F.col("plan")).drop("plan"), provenance=Provenance("approved_plan", "p1"))


def test_metric_of_one_and_two_units_and_another_template(villages):
    assert tuple(metric(villages, Scope("t1", ("v1",)), "sum", "person.count").first()) == (7, 1, 1)
    assert tuple(metric(villages, Scope("t1", UNITS), "sum", "person.count").first()) == (12, 2, 2)
    assert metric(replace(villages, provenance=None), Scope("t1", ("v1",)), "sum", "person.count").first().value == 106
    for bad in (("region_template", "x"), ("approved_plan", "x", 1), ("by_hand", "x", 1)):
        with pytest.raises(QueryError):
            Provenance(*bad)
    template = replace(villages, provenance=Provenance("document_template", "template:person", 1))
    assert metric(template, Scope("t1", ("v1",)), "sum", "person.count").first().value == 106
    assert metric(replace(villages, provenance=Provenance("document_template", "template:person", 2)), Scope("t1", ("v1",)), "sum", "person.count").first().value == 0


def test_evidence_and_aliases(villages):
    got = safe_with_evidence(villages, Scope("t1", UNITS), Safe("aggregate", measure="person.count", aggregation="sum", filters=(Filter("person.count", "gt", 6),))).first()
    assert tuple(got) == (7, 1, 1, 1)
    assert tuple(safe_with_evidence(villages, Scope("t1", UNITS), Safe("count")).first()) == (2, 2, 2, 2)
    with pytest.raises(QueryError, match="only"):
        lookup_records(villages, Scope("t1", UNITS), Catalog("count"))
    shown = serialized(aggregate_records(villages, Scope("t1", UNITS), Catalog("aggregate", measure="person.count", aggregation="sum")).withColumn("value", F.col("value").cast("decimal(38,10)")))
    assert shown.first().value == "12.0000000000"


def test_sql_rows_units_and_evidence(spark, villages):
    got = ask(villages, Scope("t1", ("v1",)), "SELECT record_id, item_id, integer_value FROM question_values WHERE field_code = :field_code", {"field_code": "person.count"})
    assert got.rows == [{"record_id": "person:1", "item_id": "f1", "integer_value": 7}] and (got.record_count, got.source_file_count, got.unit_count, got.truncated) == (1, 1, 1, False)
    got = ask(villages, Scope("t1", UNITS), "SELECT administrative_unit, SUM(integer_value) AS n FROM question_values WHERE administrative_unit IN :villages GROUP BY 1 ORDER BY 1", {"villages": ["North", "South"]}, limit=2)
    assert [(r["administrative_unit"], r["n"]) for r in got.rows] == [("North", 7), ("South", 5)] and got.truncated and (got.record_count, got.unit_count) == (2, 2)
    got = ask(villages, Scope("t1", UNITS), "SELECT COUNT(*) AS record_count, 40 AS unit_count FROM question_records")
    assert (got.record_count, got.source_file_count, got.unit_count) == (2, 2, 40)
    none = Scope("t1", UNITS, (), True)
    got = ask(villages, none, "SELECT record_id FROM question_records")
    assert got.rows == [] and got.record_count == 0
    assert tuple(metric(villages, none, "sum", "person.count").first()) == (0, 0, 0)
    got = ask(villages, Scope("t1", UNITS), "SELECT template_version, sheet_id, region_id, source_row, role, field_version, coordinate, source_sha256, source_cell_id, display_value, file_name, relative_path FROM question_records JOIN question_values USING (record_id) JOIN question_lineage USING (record_id, sheet_id) JOIN question_sources s ON s.item_id = source_item_id")
    assert [r["coordinate"] for r in got.rows] == ["A1", "A2"] and got.rows[0]["display_value"] == "7"
    with pytest.raises(QueryError, match="seconds"):
        # Slow by nature: each row multiplies the work of the last.
        slow = "WITH RECURSIVE n AS (SELECT 1 AS k FROM question_records UNION ALL SELECT k + 1 FROM n WHERE k < 90) SELECT COUNT(*) AS c FROM n"
        ask(villages, Scope("t1", UNITS), slow, seconds=0.05)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT pw FROM secret_t",
        "SELECT pw, (SELECT count(*) FROM question_records) FROM secret_t",
        "SELECT * FROM question_records WHERE record_id IN (SELECT pw FROM secret_t)",
        "SELECT * FROM question_records JOIN secret_t ON TRUE",
        "WITH a AS (SELECT * FROM secret_t) SELECT * FROM a, question_records",
        "WITH secret_t AS (SELECT * FROM secret_t) SELECT * FROM secret_t, question_records",
        "WITH a AS (WITH secret_t AS (SELECT 1 AS x) SELECT * FROM secret_t) SELECT * FROM secret_t, question_records",
        "WITH b AS (SELECT * FROM a), a AS (SELECT 1 AS x) SELECT * FROM b, question_records",
        "WITH question_records AS (SELECT * FROM secret_t) SELECT * FROM question_records",
        "SELECT record_id FROM question_records UNION SELECT pw FROM secret_t",
        "SELECT * FROM question_records, LATERAL (SELECT pw FROM secret_t)",
        "SELECT pg_sleep(10) FROM question_records",
    ],
)
def test_sql_reads_nothing_else(spark, villages, tmp_path, sql):
    spark.sql("DROP TABLE IF EXISTS secret_t")
    spark.sql(f"CREATE TABLE secret_t USING parquet LOCATION '{tmp_path}/s' AS SELECT 'x' AS pw")
    try:
        with pytest.raises(QueryError):
            guarded(villages, Scope("t1", UNITS), sql).collect()
        with pytest.raises(QueryError):
            ask(villages, Scope("t1", UNITS), sql)
    finally:
        spark.sql("DROP TABLE secret_t")


def test_common_table_expressions_in_scope(villages):
    nested = "WITH a AS (SELECT record_id FROM question_records), b AS (WITH c AS (SELECT * FROM a) SELECT * FROM c) SELECT (SELECT COUNT(*) FROM b) AS n FROM a LIMIT 1"
    assert guarded(villages, Scope("t1", UNITS), nested).first().n == 2


def test_frozen_scopes(spark, villages):
    replaced = spark.createDataFrame([("f1", "f2", "2024-01-02")], "old_id string, new_id string, at string").select("old_id", "new_id", F.col("at").cast("timestamp").alias("declared_at"))
    freeze = lambda before, *more: scoping.freeze(villages.df, "t1", UNITS, before, *more)
    ids = lambda f: sorted(r.item_id for r in f.items.collect())
    assert ids(freeze("2024-01-02 00:00:00")) == ["f1"] and ids(freeze("2024-01-03 00:00:00")) == ["f1", "f2"]  # the second file is later
    assert ids(freeze("2024-01-02 00:00:00", None, "f2")) == []  # a future item can't be selected
    assert ids(freeze("2024-01-05 00:00:00", replaced)) == ["f2"] and ids(freeze("2024-01-05 00:00:00", replaced, "f1")) == ["f1"]
    assert ids(freeze("2024-01-01 12:00:00", replaced)) == ["f1"]  # replaced by what isn't there yet
    import hashlib

    assert freeze("2024-01-03 00:00:00").fingerprint == hashlib.sha256(b"f1\nf2").hexdigest()
    assert freeze("2023-01-01 00:00:00").fingerprint == hashlib.sha256(b"").hexdigest()
    assert metric(villages, freeze("2024-01-05 00:00:00", replaced).scope, "sum", "person.count").first().value == 5


def test_store_prunes_replaces_and_deletes(spark, villages, tmp_path):
    path = str(tmp_path / "store")
    store.write(villages.df, path)
    store.write(villages.df, path)  # again: the same
    stored = store.read(spark, path, villages)
    assert stored.df.count() == 4 and sorted(stored.df.columns) == sorted(villages.df.columns)
    plan = safe(stored, Scope("t1", UNITS), Safe("count", filters=(Filter("person.count", "gt", 6),)))._jdf.queryExecution().executedPlan().toString()
    assert "approved_plan_id#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "GreaterThan(f_person__count.v,6)" in plan
    store.write(villages.df.filter("approved_plan_id = 'p1'").limit(1), path)  # a plan's next version replaces it, and only it
    assert {(r.approved_plan_id, r["count"]) for r in spark.read.parquet(path).groupBy("approved_plan_id").count().collect()} == {("p1", 1), ("p2", 1)}
    store.write(villages.df, path)
    store.without_items(path, spark, spark.createDataFrame([("f1",)], "item_id string"))
    left = spark.read.parquet(path)
    assert sorted(r.record_id for r in left.collect()) == ["person:2", "person:3"]


def test_catalog_leaves_out_what_has_no_value(spark, villages):
    versions = spark.createDataFrame([("person.count", 1, 1, "Persons", "how many", "integer", None, ["people"]), ("person.gone", 1, 1, "Gone", None, "text", None, [])], "code string, version int, published_version int, name string, description string, data_type string, unit string, aliases array<string>")
    metrics = spark.createDataFrame([("m1", 1, "published", True, "person", "person.count", None, "sum"), ("m2", 1, "published", True, "person", "person.count", ["person.gone"], "sum")], "code string, version int, status string, enabled boolean, fact_set_code string, field_code string, filter_fields array<string>, aggregation string")
    facts = replace(villages, df=villages.df.withColumn("f_person__gone", F.struct(F.lit(False).alias("present"), F.lit(None).cast("string").alias("v"))), types={**villages.types, "person.gone": "text"})
    found = scoping.build_catalog([facts], Scope("t1", UNITS), versions, metrics)
    assert [r.field_codes for r in found.fact_sets.collect()] == [["person.count"]] and [r.code for r in found.metrics.collect()] == ["m1"]
    assert [r.record_count for r in found.fact_sets.collect()] == [2]
    sets, fields, told = scoping.describe(found, search="PEOPLE")
    assert sets.count() == 0 and [r.field_code for r in fields.collect()] == ["person.count"] and told.first().matched_fields == 1
    assert scoping.build_catalog([facts], Scope("t2", UNITS), versions, metrics).fact_sets.count() == 0
    assert run_metric(metrics, {"person": facts}, Scope("t1", UNITS), "m1").first().value == 12
    for code, filters in (("nobody", ()), ("m1", (Filter("person.count", "eq", 1),))):
        with pytest.raises(QueryError):
            run_metric(metrics, {"person": facts}, Scope("t1", UNITS), code, filters)


def test_publishing_metrics(spark):
    drafts = spark.createDataFrame([("a", 1, "draft", "s", 1, "f"), ("b", 1, "draft", "s", 2, "f"), ("c", 1, "draft", "s", 1, "g"), ("d", 1, "published", "s", 1, "f"), ("e", 1, "draft", None, None, None)], "code string, version int, status string, fact_set_code string, fact_set_version int, field_code string")
    manifests = spark.createDataFrame([("s", 1, "published"), ("s", 1, "published"), ("s", 2, "draft")], "fact_set_code string, fact_set_version int, status string")
    got = {r.code: (r.status, r.problem) for r in publish_metrics(drafts, manifests, spark.createDataFrame([("f",), ("f",)], "code string")).collect()}
    assert got == {"a": ("published", None), "b": ("draft", "no_manifest"), "c": ("draft", "unpublished_field"), "d": ("published", "not_a_draft"), "e": ("draft", "no_manifest")}


def test_roles_keep_apart(spark):
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", None)], "id string, own string, other string")
    facts = wide(df, "r", F.col("id"), {"name": ("text", F.col("own"))}, F.lit("v1"), F.lit("f"), F.lit("2024-01-01"), roles={("name", "guardian"): F.col("other")}, dimensions=("r.name",))
    rows = guarded(facts, Scope("t1", ("v1",)), "SELECT record_id, role, text_value FROM question_values ORDER BY 1, 2").collect()
    assert [tuple(r) for r in rows] == [("r:1", "", "a"), ("r:1", "guardian", "x"), ("r:2", "", "b")]
    assert safe(facts, Scope("t1", ("v1",)), Safe("count", filters=(Filter("r.name", "eq", "x"),))).first().value == 0


def test_suffixed_roles(spark):
    rows = [("r", "a", 1, "", "guardian", False), ("r", "a", 2, "", None, True), ("r", "a", 3, "", None, False), ("r", "a", 4, "guardian", None, False), ("r", "a", 5, "guardian", "check", False), ("r", "b", 6, None, None, None)]
    got = {r.place: (r.role, r.review) for r in suffixed_roles(spark.createDataFrame(rows, "region_id string, code string, place int, role string, base_role string, preferred boolean")).collect()}
    assert got == {1: ("guardian_2", True), 2: ("", False), 3: ("duplicate", True), 4: ("guardian", False), 5: ("check", True), 6: ("", False)}


def test_source_lookups_keep_to_the_scope(spark, villages):
    cell = lambda path, v: {"header_path": path, "value": v}
    rows = [("person:1", "t1", "v1", "f1", "s", {"c1": cell(["人", "地址"], "重庆市巴南区"), "c2": cell(["人", "地址"], "青禾组180号"), "c3": cell(["出生"], "1930年10月20日")}), ("person:2", "t1", "v2", "f2", "s", {"c1": cell(["人", "地址"], "重庆市巴南区青禾组180")}), ("x", "t2", "v1", "f9", "s", {"c1": cell(["人", "地址"], "重庆市巴南区青禾组180")})]
    raw = spark.createDataFrame(rows, "record_id string, tenant_id string, unit_id string, item_id string, sheet_id string, columns map<string, struct<header_path: array<string>, value: string>>").withColumns({"quality_status": F.lit("passed"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    both = Scope("t1", UNITS)
    address = [("地址", "contains", "重庆市巴南区青禾组180")]
    assert [r.record_id for r in source_rows(raw, both, ["出生"], address, limit=100).collect()] == ["person:1", "person:2"]
    assert [r.record_id for r in source_rows(raw, Scope("t1", ("v2",)), [], address).collect()] == ["person:2"]
    got = source_rows(raw, both, ["出生"], address, villages, (Filter("person.count", "eq", 7),)).collect()
    assert [(r.record_id, r.shown[0].value) for r in got] == [("person:1", "1930年10月20日")]
    assert [tuple(r.headers) for r in source_fields(raw, Scope("t1", ("v1",))).collect()] == [("人 / 地址", "出生")]
    for bad in (dict(limit=101), dict(semantic=(Filter("a", "eq", 1),))):
        with pytest.raises(QueryError):
            source_rows(raw, both, [], [], **bad)


def test_facts_of_a_sheet_with_their_lineage(spark):
    cells, maps = cells_and_maps(spark)
    facts = fact_set(materialize(cells, maps, 2), "person", {"person.name": "text", "household.size": "integer"}, ITEMS(spark), measures={"household.size": Measure(("sum",))}, dimensions=("person.name",))
    scope = Scope("t1", ("v1",))
    assert tuple(metric(facts, scope, "sum", "household.size").first()) == (5, 2, 1)
    assert metric(facts, scope, "sum", "household.size", (Filter("person.name", "eq", "李四"),)).first().value == 3
    got = ask(facts, scope, "SELECT coordinate, display_value, file_name FROM question_lineage JOIN question_sources ON item_id = source_item_id WHERE field_code = 'household.size' ORDER BY 1")
    assert [tuple(r.values()) for r in got.rows] == [("C2", "2", "a.xlsx"), ("C3", "3", "a.xlsx")]
    assert facts.df.filter(facts.present("household.size")).count() == 2


def test_rows_that_are_no_records(spark):
    cells, maps = cells_and_maps(spark)
    assert sorted(r.row for r in excluded_rows(cells.filter("row > 1"), maps).collect()) == [5, 6, 7]
    raw = {r.row: r["columns"] for r in raw_rows(cells, spark.createDataFrame([(0, 2, ["姓名"])], "sheet int, col int, header_path array<string>")).collect()}
    assert raw[2]["B"].header_path == ["姓名"] and raw[2]["D"].header_path == [] and raw[2]["D"].coordinate == "D2"


def test_decimals_keep_ten_places(spark):
    from granary.functions.values import parse

    got = spark.createDataFrame([("22.75068493150685",), ("1.00000000005",), ("-1.00000000005",)], "t string").select(parse(F.col("t"), "decimal").alias("v"))
    assert [r.v for r in got.collect()] == [Decimal("22.7506849315"), Decimal("1.0000000001"), Decimal("-1.0000000001")]
