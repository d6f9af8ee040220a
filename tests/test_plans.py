"""Governed plans on small fact sets with known answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.plans.answers import Catalog, Safe, catalog, metric, safe
from granary.plans.contracts import CoverageError, FactSet, Filter, Measure, QueryError, Scope
from granary.plans.guarded_sql import run as guarded
from granary.sources.facts import wide

SCOPE = Scope("t1", ("v1",))


@pytest.fixture(scope="module")
def persons(spark):
    rows = [("P-1", "女", "2.00"), ("P-2", "女", "3.00"), ("P-3", "男", "4.00")]
    df = spark.createDataFrame(rows, "id string, gender string, amount string")
    return wide(
        df, "benefit", F.col("id"), {"id": ("text", F.col("id")), "gender": ("text", F.col("gender")), "amount": ("decimal", F.col("amount").cast("decimal(38,10)"))}, F.lit("v1"), F.lit("f1"), F.lit("2024-01-01"),
        identity=("benefit.id",), dimensions=("benefit.gender", "benefit.id"), blocked=("benefit.id",),
        measures={"benefit.amount": Measure(("sum", "avg", "min", "max")), "benefit.id": Measure(("count",), False, True)},
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_count_list_sum(persons):
    women = (Filter("benefit.gender", "eq", "女"),)
    assert rows(safe(persons, SCOPE, Safe("count", filters=women))) == [(2,)]
    listed = safe(persons, SCOPE, Safe("list", select=("benefit.id",), order_by=(("benefit.id", "desc"),), limit=2))
    assert [r.id for r in listed.collect()] == ["P-3", "P-2"]
    assert rows(safe(persons, SCOPE, Safe("aggregate", measure="benefit.amount", aggregation="sum"))) == [(Decimal("9.0000000000"),)]
    grouped = safe(persons, SCOPE, Safe("group_by", group_by=("benefit.gender",), measure="benefit.amount", aggregation="sum"))
    assert dict(rows(grouped)) == {"女": Decimal(5), "男": Decimal(4)}
    counted = safe(persons, SCOPE, Safe("group_by", group_by=("benefit.gender",), measure="benefit.id", aggregation="count"))
    assert dict(rows(counted)) == {"女": 2, "男": 1}
    assert len(persons.fingerprint()) == 64


def test_contract_errors(persons):
    with pytest.raises(QueryError, match="published fact set"):
        safe(persons.published("derived"), SCOPE, Safe("count"))
    with pytest.raises(QueryError, match="blocked sensitive fields"):
        safe(persons, SCOPE, Safe("list", select=("benefit.id",)), enforce_sensitive=True)
    with pytest.raises(QueryError, match="not published dimensions"):
        safe(persons, SCOPE, Safe("count", filters=(Filter("benefit.amount", "gt", 1),)))
    with pytest.raises(QueryError, match="not allowed for this measure"):
        safe(persons, SCOPE, Safe("aggregate", measure="benefit.id", aggregation="sum"))
    for bad in (lambda: Safe("list"), lambda: Safe("aggregate"), lambda: Catalog("rank"), lambda: Catalog("list", ("a",), limit=201), lambda: Catalog("count", requested=("a",))):
        with pytest.raises(QueryError):
            bad()
    with pytest.raises(QueryError, match="not numeric"):
        FactSet("x", persons.df, {"x.a": "text"}, measures={"x.a": Measure(("sum",))})


def test_group_counts_cover(spark):
    df = spark.createDataFrame([("1", "男"), ("2", "男"), ("3", None)], "id string, sex string")
    facts = wide(df.filter("sex is not null"), "p", F.col("id"), {"sex": ("text", F.col("sex"))}, F.lit("v1"), F.lit("f"), F.lit("2024-01-01"))
    assert rows(catalog(facts, SCOPE, Catalog("group_count", group_by="p.sex", requested=("男", "女")))) == [("男", 2), ("女", 0)]
    holes = wide(df, "p", F.col("id"), {"sex": ("text", F.col("sex"))}, F.lit("v1"), F.lit("f"), F.lit("2024-01-01"), absent={"sex": F.col("sex").isNull()})
    with pytest.raises(CoverageError):
        catalog(holes, SCOPE, Catalog("group_count", group_by="p.sex"))


def test_empty_sums_and_null_identities(spark, persons):
    none = Scope("t1", ("v1",), (), True)
    assert rows(metric(persons, none, "sum", "benefit.amount")) == [(Decimal(0), 0, 0)]
    assert rows(safe(persons, none, Safe("aggregate", measure="benefit.amount", aggregation="sum"))) == [(None,)]
    df = spark.createDataFrame([("1", "a"), ("2", None), ("3", None)], "id string, k string")
    facts = wide(df, "n", F.col("id"), {"k": ("text", F.col("k"))}, F.lit("v1"), F.lit("f"), F.lit("2024-01-01"), identity=("n.k",), dimensions=("n.k",))
    assert metric(facts, SCOPE, "count").first().value == 2  # NULL is a tuple of its own
    assert safe(facts, SCOPE, Safe("count")).first().value == 1


def test_contains_is_a_pattern_unless_escaped(spark):
    from granary.operators.select import condition

    df = spark.createDataFrame([("axb",), ("a_b",)], "t string")
    facts = wide(df, "c", F.col("t"), {"t": ("text", F.col("t"))}, F.lit("v1"), F.lit("f"), F.lit("2024-01-01"))
    f = Filter("c.t", "contains", "a_b")
    assert facts.df.filter(condition(facts, f)).count() == 2
    assert facts.df.filter(condition(facts, f, escape=True)).count() == 1


def test_filters_reach_the_scan(spark, tmp_path, persons):
    persons.df.write.parquet(str(tmp_path / "p"))
    stored = FactSet("benefit", spark.read.parquet(str(tmp_path / "p")), persons.types, identity=persons.identity, dimensions=persons.dimensions)
    plan = safe(stored, SCOPE, Safe("count", filters=(Filter("benefit.gender", "eq", "女"),)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(f_benefit__gender.v" in plan and "f_benefit__amount" not in plan


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT username FROM users",
        "DELETE FROM question_records",
        "SELECT 1",
        "SELECT reflect('java.lang.System', 'exit', 1) FROM question_records",
        "SELECT * FROM parquet.`/tmp/x`, question_records",
        "SELECT 1 FROM question_records; SELECT 2",
        "SHOW TABLES",
        "SELECT (SELECT java_method('a', 'b')) FROM question_records",
        "SELECT * FROM question_records WHERE record_id IN (SELECT name FROM other.t)",
        "SELECT * FROM range(10), question_records",
        "SELECT '" + "x" * 8001 + "' FROM question_records",
    ],
)
def test_guard_refuses(persons, sql):
    with pytest.raises(Exception) as e:
        guarded(persons, SCOPE, sql).collect()
    assert isinstance(e.value, QueryError) or "TABLE_OR_VIEW_NOT_FOUND" in str(e.value)


def test_guard_runs(persons):
    assert guarded(persons, SCOPE, "SELECT COUNT(*) AS n FROM question_records").first().n == 3
    got = guarded(persons, SCOPE, "SELECT record_id FROM question_values WHERE field_code = 'benefit.gender' AND text_value IN :g ORDER BY 1 DESC", {"g": ["女", "x"]}, limit=1)
    assert rows(got) == [("benefit:P-2",)]
    with pytest.raises(QueryError, match="parameter name"):
        guarded(persons, SCOPE, "SELECT 1 FROM question_records WHERE 1 = :__vi_a", {"__vi_a": 1})
