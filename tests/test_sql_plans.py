"""What guarded SQL reads: only the fields and columns that a query asks for."""

import re

from granary.plans.guarded_sql import run
from granary.sources import facts as S
from tests.test_entry import DATA


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.*?)\], ReadSchema", text)


def test_a_query_for_one_field_reads_that_field(spark):
    facts = S.part(spark, DATA)
    one = scans(run(facts, S.ALL, "SELECT SUM(integer_value) AS n FROM question_values WHERE field_code = 'part.size' AND integer_value > 10"))
    assert len(one) == 1
    columns, filters = one[0]
    assert {c.split("#")[0] for c in columns.split(",")} <= {"p_size", "p_partkey"} and "p_size" in filters
    two = scans(run(facts, S.ALL, "SELECT a.text_value, COUNT(*) AS n FROM question_values a JOIN question_values b ON a.record_id = b.record_id WHERE a.field_code = 'part.brand' AND b.field_code = 'part.size' GROUP BY 1"))
    assert len(two) == 2 and not any("p_name" in c or "p_retailprice" in c for c, _ in two)


def test_unit_names_are_joined_where_they_are_asked_for(spark):
    facts = S.part(spark, DATA)
    plan = lambda sql: run(facts, S.ALL, sql)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("SELECT COUNT(*) AS n FROM question_values WHERE field_code = 'part.brand'")
    assert "Join" in plan("SELECT administrative_unit, COUNT(*) AS n FROM question_records GROUP BY 1")
    assert {r.administrative_unit for r in run(facts, S.ALL, "SELECT * FROM question_records LIMIT 5").collect()} == {"everywhere"}
