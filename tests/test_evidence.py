"""Evidence of stored records by bitmaps."""

from pyspark.sql import functions as F

from granary.operators.aggregate import evidence
from granary.operators.select import scoped
from granary.plans.answers import Safe, metric, safe_with_evidence
from granary.queries_store import stored_orders
from granary.sources import facts as S
from tests.test_entry import DATA


def test_bitmaps_count_what_distinct_counts_do(spark):
    facts = stored_orders(spark, DATA)
    for condition in ("true", "o_x > 100000", "o_x < 0"):
        df = scoped(facts, S.ALL).withColumn("o_x", facts.value("orders.totalprice").cast("double")).filter(condition)
        want = df.agg(F.countDistinct("record_id").alias("record_count"), F.countDistinct("item_id").alias("source_file_count"), F.countDistinct("unit_id").alias("unit_count")).first()
        assert evidence(df, stored=True).first() == want == evidence(df).first()
    plan = evidence(scoped(facts, S.ALL), stored=True)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and "record_id" not in plan and "bitmap_construct_agg" in plan
    told = metric(facts, S.ALL, "sum", "orders.totalprice").first()
    plain = metric(S.orders(spark, DATA), S.ALL, "sum", "orders.totalprice").first()
    assert told == plain
    shape = Safe("group_by", group_by=("orders.status",), measure="orders.totalprice", aggregation="max")
    assert sorted(map(tuple, safe_with_evidence(facts, S.ALL, shape).collect())) == sorted(map(tuple, safe_with_evidence(S.orders(spark, DATA), S.ALL, shape).collect()))
