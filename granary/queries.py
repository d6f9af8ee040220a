"""Queries by plans and by single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import values as V
from .operators import listing as L
from .operators import maintenance as M
from .operators.aggregate import evidence
from .operators.select import condition, filtered, long_values, projected, scoped
from .plans.answers import Catalog, Safe, catalog, metric, safe
from .plans.contracts import ORIGIN, RECORD, Filter, Scope
from .plans.guarded_sql import run as guarded
from .plans.lookup import household, source_fields, source_rows
from .plans.scoping import discovered
from .registry import query
from .sources import facts as S

# The wide orders fact set in SQL.
ORDERS = """orders_f AS (
  SELECT o.*, COALESCE(c.c_nationkey, 0) AS unit, 'orders:' || o_orderkey AS record_id, 'orders#' || (o_orderkey % 4) AS item_id,
    CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,10)) AS price
  FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 0
)"""
PRICE = "CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,10))"


def real(df, *columns):
    """Decimals as doubles of six places, the same in any engine."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# Safe queries.


@query(f"WITH {ORDERS} SELECT o_orderpriority AS priority, ROUND(CAST(SUM(price) AS DOUBLE), 6) AS value FROM orders_f WHERE o_orderstatus = 'F' GROUP BY 1")
def safe_group_orders_priority(spark, d):
    plan = Safe("group_by", filters=(Filter("orders.status", "eq", "F"),), group_by=("orders.priority",), measure="orders.totalprice", aggregation="sum")
    return real(safe(S.orders(spark, d), S.ALL, plan), "value")


@query(f"WITH {ORDERS} SELECT COUNT(DISTINCT o_orderkey) AS value FROM orders_f WHERE o_orderstatus = 'O'")
def safe_count_orders(spark, d):
    return safe(S.orders(spark, d), S.ALL, Safe("count", filters=(Filter("orders.status", "eq", "O"),)))


@query(f"WITH {ORDERS} SELECT record_id, item_id, o_orderkey::INT AS key, ROUND(CAST(price AS DOUBLE), 6) AS totalprice FROM orders_f WHERE o_orderpriority LIKE '%URG%' ORDER BY price DESC, record_id LIMIT 20")
def safe_list_orders(spark, d):
    plan = Safe("list", select=("orders.key", "orders.totalprice"), filters=(Filter("orders.priority", "contains", "URG"),), order_by=(("orders.totalprice", "desc"),), limit=20)
    return real(safe(S.orders(spark, d), S.ALL, plan), "totalprice")


@query(f"WITH {ORDERS} SELECT record_id, item_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS closed FROM orders_f WHERE o_orderstatus <> 'O' ORDER BY closed DESC NULLS FIRST, record_id LIMIT 30")
def safe_list_null_order(spark, d):
    return safe(S.orders(spark, d), S.ALL, Safe("list", select=("orders.closed",), order_by=(("orders.closed", "desc"),), limit=30))


@query(f"WITH {ORDERS} SELECT o_orderpriority AS priority, COUNT(DISTINCT o_orderkey) AS value FROM orders_f GROUP BY 1")
def safe_group_distinct_count(spark, d):
    return safe(S.orders(spark, d), S.ALL, Safe("group_by", group_by=("orders.priority",), measure="orders.key", aggregation="count"))


@query(f"WITH {ORDERS} SELECT o_orderstatus AS status, o_orderpriority AS priority, ROUND(CAST(AVG(price) AS DOUBLE), 4) AS value FROM orders_f GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200")
def safe_group_two_keys(spark, d):
    plan = Safe("group_by", group_by=("orders.status", "orders.priority"), measure="orders.totalprice", aggregation="avg", limit=200)
    return safe(S.orders(spark, d), S.ALL, plan).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"WITH {ORDERS} SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS closed, ROUND(CAST(MAX(price) AS DOUBLE), 6) AS value FROM orders_f WHERE o_orderstatus <> 'O' GROUP BY 1")
def safe_group_null_key(spark, d):
    return real(safe(S.orders(spark, d), S.ALL, Safe("group_by", group_by=("orders.closed",), measure="orders.totalprice", aggregation="max")), "value")


for how in ("sum", "avg", "min", "max"):

    def _aggregate(spark, d, how=how):
        df = safe(S.lineitem(spark, d), S.ALL, Safe("aggregate", filters=(Filter("lineitem.flag", "eq", "R"),), measure="lineitem.price", aggregation=how))
        return df.select(F.round(F.col("value").cast("double"), 4).alias("value"))

    query(f"SELECT ROUND(CAST({how.upper()}({PRICE}) AS DOUBLE), 4) AS value FROM lineitem WHERE l_returnflag = 'R'", f"safe_aggregate_{how}_lineitem")(_aggregate)

    def _metric(spark, d, how=how):
        df = metric(S.lineitem(spark, d), S.ALL, how, "lineitem.quantity", (Filter("lineitem.status", "eq", "F"),))
        return df.select(F.round(F.col("value").cast("double"), 4).alias("value"), "record_count", "source_file_count")

    query(f"SELECT ROUND(CAST({how.upper()}(CAST(CAST(l_quantity AS VARCHAR) AS DECIMAL(38,10))) AS DOUBLE), 4) AS value, COUNT(DISTINCT l_orderkey || '-' || l_linenumber) AS record_count, COUNT(DISTINCT l_orderkey % 4) AS source_file_count FROM lineitem WHERE l_linestatus = 'F'", f"metric_{how}_lineitem")(_metric)


# Metrics.


@query("SELECT COUNT(DISTINCT user_id) AS value, COUNT(DISTINCT event_id) AS record_count, COUNT(DISTINCT event_id % 4) AS source_file_count FROM events WHERE event_type = 'error'")
def metric_count_identity_events(spark, d):
    return metric(S.events(spark, d), S.ALL, "count", filters=(Filter("events.type", "eq", "error"),))


@query(f"WITH {ORDERS} SELECT COUNT(*) AS value, (SELECT COUNT(*) FROM orders_f) AS record_count, (SELECT COUNT(DISTINCT item_id) FROM orders_f) AS source_file_count FROM (SELECT DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END FROM orders_f WHERE o_orderstatus <> 'O')")
def metric_count_null_identity(spark, d):
    return metric(S.orders(spark, d), S.ALL, "count", identity=("orders.closed",))


@query("SELECT COUNT(*) AS value, COUNT(*) AS record_count, COUNT(DISTINCT p_partkey % 4) AS source_file_count FROM part WHERE p_brand = 'Brand#11'")
def metric_count_records_part(spark, d):
    return metric(S.part(spark, d), S.ALL, "count", filters=(Filter("part.brand", "eq", "Brand#11"),), identity=())


@query("SELECT 0.0::DOUBLE AS value, 0::BIGINT AS record_count, 0::BIGINT AS source_file_count")
def metric_sum_empty_scope(spark, d):
    none = Scope(S.TENANT, S.ALL.units, (), True)
    return metric(S.lineitem(spark, d), none, "sum", "lineitem.quantity").withColumn("value", F.col("value").cast("double"))


# Catalog queries.


@query("SELECT record_id, item_id, price, name FROM (SELECT 'part:' || p_partkey AS record_id, 'part#' || (p_partkey % 4) AS item_id, ROUND(p_retailprice, 6) AS price, p_name AS name FROM part) ORDER BY price DESC, record_id LIMIT 25")
def catalog_rank_part(spark, d):
    return real(catalog(S.part(spark, d), S.ALL, Catalog("rank", ("part.name",), order_by="part.price", direction="desc", limit=25)), "price")


@query("SELECT event_type AS value, COUNT(*) AS record_count FROM events GROUP BY 1")
def catalog_group_count_events(spark, d):
    return catalog(S.events(spark, d), S.ALL, Catalog("group_count", group_by="events.type"))


@query("SELECT v AS value, COALESCE(n, 0)::BIGINT AS record_count FROM (VALUES ('view'), ('click'), ('error'), ('signup'), ('purchase'), ('refund')) r(v) LEFT JOIN (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) ON event_type = v")
def catalog_group_count_requested(spark, d):
    return catalog(S.events(spark, d), S.ALL, Catalog("group_count", group_by="events.type", requested=("view", "click", "error", "signup", "purchase", "refund")))


@query(f"SELECT l_returnflag AS flag, ROUND(CAST(SUM({PRICE}) AS DOUBLE), 4) AS value FROM lineitem GROUP BY 1")
def catalog_aggregate_grouped_lineitem(spark, d):
    return catalog(S.lineitem(spark, d), S.ALL, Catalog("aggregate", group_by="lineitem.flag", measure="lineitem.price", aggregation="sum")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"WITH {ORDERS} SELECT COUNT(DISTINCT record_id) AS value FROM orders_f WHERE o_totalprice > 200000")
def catalog_count_boolean(spark, d):
    return catalog(S.orders(spark, d), S.ALL, Catalog("count", filters=(Filter("orders.large", "eq", True),)))


@query("SELECT 'part:' || p_partkey AS record_id, 'part#' || (p_partkey % 4) AS item_id, p_brand AS brand, p_size AS size FROM part ORDER BY 1 LIMIT 40")
def catalog_list_part(spark, d):
    return catalog(S.part(spark, d), S.ALL, Catalog("list", ("part.brand", "part.size"), limit=40))


# Filters, scope and evidence.

for label, f, where in (
    ("eq", Filter("orders.priority", "eq", "1-URGENT"), "o_orderpriority = '1-URGENT'"),
    ("in", Filter("orders.status", "in", ["F", "P"]), "o_orderstatus IN ('F', 'P')"),
    ("gt", Filter("orders.totalprice", "gt", "250000"), "price > 250000"),
    ("gte", Filter("orders.day", "gte", "1997-01-01"), "CAST(o_orderdate AS DATE) >= DATE '1997-01-01'"),
    ("lt", Filter("orders.customer", "lt", "100"), "o_custkey < 100"),
    ("lte", Filter("orders.date", "lte", "1994-06-30 00:00:00"), "o_orderdate <= TIMESTAMP '1994-06-30'"),
    ("contains", Filter("orders.priority", "contains", "_-%I"), "o_orderpriority LIKE '%_-%I%'"),
    ("eq_null", Filter("orders.closed", "eq", ""), "o_orderstatus = 'P'"),
):

    def _filter(spark, d, f=f):
        facts = S.orders(spark, d)
        return evidence(filtered(scoped(facts, S.ALL), facts, [f]))

    query(f"WITH {ORDERS} SELECT COUNT(DISTINCT record_id) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count FROM orders_f WHERE {where}", f"filter_{label}_orders")(_filter)

for label, scope, where in (
    ("unit", Scope(S.TENANT, ("1", "2", "3")), "unit IN (1, 2, 3)"),
    ("item", Scope(S.TENANT, S.ALL.units, ("orders#1",)), "item_id = 'orders#1'"),
    ("watermark", Scope(S.TENANT, S.ALL.units, before="1995-06-17 00:00:00"), "o_orderdate <= TIMESTAMP '1995-06-17'"),
    ("tenant", Scope("another", S.ALL.units), "FALSE"),
    ("no_items", Scope(S.TENANT, S.ALL.units, (), True), "FALSE"),
):

    def _scope(spark, d, scope=scope):
        return evidence(scoped(S.orders(spark, d), scope))

    query(f"WITH {ORDERS} SELECT COUNT(DISTINCT record_id) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count FROM orders_f WHERE {where}", f"scope_{label}_orders")(_scope)


@query(f"""WITH {ORDERS} SELECT 'orders' AS record_type, 'approved_plan:orders' AS provenance, COUNT(DISTINCT record_id) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count FROM orders_f
UNION ALL SELECT 'part', 'approved_plan:part', COUNT(*), COUNT(DISTINCT p_partkey % 4), 1 FROM part""")
def catalog_discovery(spark, d):
    columns = [*RECORD, *ORIGIN]
    both = S.orders(spark, d).df.select(columns).unionByName(S.part(spark, d).df.select(columns))
    found = discovered(both, S.ALL).withColumn("provenance", F.concat(F.lit("approved_plan:"), F.regexp_replace("approved_plan_id", "^plan:", "")))
    return found.select("record_type", "provenance", "record_count", "source_file_count", "unit_count")


@query(f"""WITH {ORDERS} SELECT field_code, COUNT(*) AS n, COUNT(v) AS n_values FROM (
  SELECT unnest(['orders.key', 'orders.status', 'orders.priority', 'orders.totalprice', 'orders.date', 'orders.day', 'orders.customer', 'orders.large']) AS field_code, 1 AS v FROM orders_f
  UNION ALL SELECT 'orders.closed', CASE WHEN o_orderstatus <> 'P' THEN 1 END FROM orders_f WHERE o_orderstatus <> 'O') GROUP BY 1""")
def value_rows_orders(spark, d):
    facts = S.orders(spark, d)
    rows = long_values(facts, scoped(facts, S.ALL))
    typed = F.coalesce(*[F.col(f"{k}_value").cast("string") for k in V.SPARK_TYPES])
    return rows.groupBy("field_code").agg(F.count(F.lit(1)).alias("n"), F.count(typed).alias("n_values"))


# Households and source rows.


@query("""SELECT 'customer:' || c_custkey AS record_id, 'customer#' || (c_custkey % 4) AS item_id, c_name AS person FROM customer
WHERE c_custkey = (SELECT MIN(c_custkey) FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_name = 'Customer#000000007'))""")
def household_head(spark, d):
    return household(S.customer(spark, d), S.ALL, "person_name", "Customer#000000007", "head", "customer.household", "customer.person", "customer.relation", ("customer.person",))


@query("SELECT 'customer:' || c_custkey AS record_id, 'customer#' || (c_custkey % 4) AS item_id, c_name AS person, c_mktsegment AS segment FROM customer WHERE c_nationkey = 7")
def household_members(spark, d):
    return household(S.customer(spark, d), S.ALL, "household_number", "H007", "members", "customer.household", "customer.person", "customer.relation", ("customer.person", "customer.segment"))


def _raw_parts(spark, d):
    """Parts as raw rows, the name split over two columns of one header."""
    p = S.table(spark, d, "part")
    cell = lambda value, *path: F.struct(F.array(*map(F.lit, path)).alias("header_path"), value.cast("string").alias("value"))
    words = F.split("p_name", "[ #]", 2)
    columns = F.create_map(F.lit("c1"), cell(words[0], "Part", "Name 1"), F.lit("c2"), cell(F.coalesce(F.get(words, F.lit(1)), F.lit("")), "Part", "Name 2"), F.lit("c3"), cell(F.col("p_brand"), "Maker", "Brand"), F.lit("c4"), cell(F.col("p_size"), "Size"))
    return p.select(
        "p_partkey", F.concat(F.lit("part:"), "p_partkey").alias("record_id"), S.file_of("part", F.col("p_partkey")).alias("item_id"), F.lit("sheet1").alias("sheet_id"), columns.alias("columns"),
        F.lit(S.TENANT).alias("tenant_id"), F.lit("0").alias("unit_id"), F.lit("passed").alias("quality_status"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


@query("SELECT 'part#' || k AS item_id, 'sheet1' AS sheet_id, 'Maker / Brand|Part / Name 1|Part / Name 2|Size' AS headers FROM (SELECT DISTINCT p_partkey % 4 AS k FROM part)")
def source_fields_part(spark, d):
    return source_fields(_raw_parts(spark, d), S.ALL).withColumn("headers", F.array_join("headers", "|"))


@query("SELECT p_partkey, item_id, 1::INT AS n_shown FROM (SELECT p_partkey, 'part#' || (p_partkey % 4) AS item_id FROM part WHERE p_brand = 'Brand#13' AND contains(lower(regexp_replace(p_name, '[ #]', '')), 'a'))")
def source_rows_part(spark, d):
    found = source_rows(_raw_parts(spark, d), S.ALL, ["size"], [("brand", "eq", "brand#13"), ("part / name", "contains", "A")])
    return found.select("p_partkey", "item_id", F.size("shown").alias("n_shown"))


# Guarded SQL.

SQLS = {
    "sql_group": ("SELECT field_code, COUNT(*) AS n FROM question_values WHERE data_type = :kind GROUP BY field_code", {"kind": "text"},
        "SELECT * FROM (VALUES ('part.name', 1), ('part.brand', 1)) t(field_code, k) JOIN (SELECT COUNT(*) AS n FROM part) ON TRUE"),
    "sql_list_parameter": ("SELECT record_id, text_value AS brand FROM question_values WHERE field_code = 'part.brand' AND text_value IN :brands ORDER BY record_id", {"brands": ["Brand#11", "Brand#12"]},
        "SELECT 'part:' || p_partkey AS record_id, p_brand AS brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') ORDER BY record_id LIMIT 50"),
    "sql_join_cte": ("WITH big AS (SELECT record_id, integer_value AS size FROM question_values WHERE field_code = 'part.size' AND integer_value > 45) SELECT item_id, COUNT(*) AS n, MAX(size) AS most FROM question_records JOIN big USING (record_id) GROUP BY item_id", {},
        "SELECT 'part#' || (p_partkey % 4) AS item_id, COUNT(*) AS n, MAX(p_size) AS most FROM part WHERE p_size > 45 GROUP BY 1"),
    "sql_window": ("SELECT record_id, place FROM (SELECT record_id, row_number() OVER (ORDER BY integer_value DESC, record_id) AS place FROM question_values WHERE field_code = 'part.size') WHERE place <= 10 ORDER BY place", {},
        "SELECT 'part:' || p_partkey AS record_id, row_number() OVER (ORDER BY p_size DESC, 'part:' || p_partkey)::INT AS place FROM part QUALIFY place <= 10"),
    "sql_setop": ("SELECT record_id FROM question_values WHERE field_code = 'part.size' AND integer_value = 50 EXCEPT SELECT record_id FROM question_values WHERE field_code = 'part.brand' AND text_value = 'Brand#11' ORDER BY record_id", {},
        "SELECT 'part:' || p_partkey AS record_id FROM part WHERE p_size = 50 AND p_brand <> 'Brand#11' ORDER BY 1 LIMIT 50"),
    "sql_rollup": ("SELECT item_id, COUNT(*) AS n FROM question_records GROUP BY ROLLUP(item_id)", {}, "SELECT 'part#' || (p_partkey % 4) AS item_id, COUNT(*) AS n FROM part GROUP BY ROLLUP(item_id)"),
    "sql_subquery": ("SELECT COUNT(*) AS n FROM question_records r WHERE EXISTS (SELECT 1 FROM question_values v WHERE v.record_id = r.record_id AND v.field_code = 'part.size' AND v.integer_value >= (SELECT MAX(integer_value) FROM question_values WHERE field_code = 'part.size'))", {},
        "SELECT COUNT(*) AS n FROM part WHERE p_size = (SELECT MAX(p_size) FROM part)"),
    "sql_filter_clause": ("SELECT COUNT(*) FILTER (WHERE integer_value > 25) AS large, COUNT(*) AS n FROM question_values WHERE field_code = 'part.size'", {}, "SELECT COUNT(*) FILTER (WHERE p_size > 25) AS large, COUNT(*) AS n FROM part"),
    "sql_sources": ("SELECT item_id, record_count, unit_count FROM question_sources", {}, "SELECT 'part#' || (p_partkey % 4) AS item_id, COUNT(*) AS record_count, 1::BIGINT AS unit_count FROM part GROUP BY 1"),
}
for label, (text, params, oracle) in SQLS.items():

    def _sql(spark, d, text=text, params=params):
        return guarded(S.part(spark, d), S.ALL, text, params)

    query(oracle.replace("SELECT * FROM (VALUES", "SELECT field_code, n FROM (VALUES"), label)(_sql)


# Listings and reports.


@query("SELECT c_custkey, c_name, COALESCE(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def ledger_left_join_customer(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.with_count(S.table(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"], "n_orders")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging_orders(spark, d):
    return L.page(S.table(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100, 50).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS n_F, COUNT(*) FILTER (o_orderstatus = 'O') AS n_O, COUNT(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders GROUP BY 1")
def status_rollup_orders(spark, d):
    return L.status_rollup(S.table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 5")
def best_per_group_part(spark, d):
    return L.best(S.table(spark, d, "part"), ["p_brand"], [F.col("p_size").desc(), F.col("p_partkey")], 5).select("p_brand", "p_partkey", "p_size")


@query("SELECT p_brand, p_partkey, p_size, p_size - COALESCE(nxt, 0) AS margin FROM (SELECT *, lead(p_size) OVER w AS nxt, row_number() OVER w AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)) WHERE r = 1")
def margin_per_group_part(spark, d):
    return L.margin(S.table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS duplicate FROM events")
def duplicate_identity_events(spark, d):
    return L.later_duplicates(S.table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "duplicate")


@query("SELECT conv_id, turn, COALESCE(last_value(q IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1)::BIGINT AS question FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS q FROM conversations)")
def forward_fill_conversations(spark, d):
    c = S.table(spark, d, "conversations").withColumn("q", F.when(F.col("role") == "user", F.col("turn")))
    return L.fill_down(c, "q", ["conv_id"], [F.col("turn")], "question").select("conv_id", "turn", F.coalesce("question", F.lit(-1).cast("long")).alias("question"))


@query("SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n, MIN(o_orderkey) AS first_member, array_to_string(list_sort(list_distinct(flatten(list([o_orderpriority, o_orderstatus])))), '|') AS labels FROM orders GROUP BY 1, 2")
def cluster_orders(spark, d):
    o = S.table(spark, d, "orders").withColumn("l", F.array("o_orderpriority", "o_orderstatus"))
    return L.clusters(o, ["o_orderpriority", "o_orderstatus"], "o_orderkey", "l").withColumn("labels", F.array_join("labels", "|"))


@query("SELECT s_nationkey AS n_nationkey, COUNT(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def anti_join_supplier(spark, d):
    out = S.table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return L.without(S.table(spark, d, "supplier"), out, ["s_nationkey"]).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_size, CASE WHEN k IS NULL THEN 'inserted' WHEN p_partkey IS NULL THEN 'extra' WHEN p_size = sz THEN 'unchanged' ELSE 'updated' END AS outcome FROM (SELECT COALESCE(n.p_partkey, k) AS p_partkey, CASE WHEN n.p_partkey IS NULL THEN sz ELSE n.p_size END AS p_size, k, sz, n.p_partkey AS nk FROM (SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0) n FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS sz FROM part WHERE p_partkey % 7 <> 0) s ON n.p_partkey = k) WHERE nk IS NOT NULL UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END, 'extra' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0")
def merge_by_key_part(spark, d):
    p = S.table(spark, d, "part").select("p_partkey", "p_size")
    stored = p.filter("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return L.merge_by_key(stored, p.filter("p_partkey % 3 <> 0"), "p_partkey", ["p_size"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%0012%' OR c_mktsegment ILIKE '%mach%'")
def search_any_column_customer(spark, d):
    return S.table(spark, d, "customer").filter(V.like_any([F.col("c_name"), F.col("c_mktsegment")], "0012") | V.like_any([F.col("c_mktsegment")], "mach")).select("c_custkey", "c_name")


@query("SELECT l_returnflag, CAST(round_even(10000.0 * COUNT(*) FILTER (l_linestatus = 'F') / COUNT(*), 0) AS BIGINT) AS points FROM lineitem GROUP BY 1")
def coverage_points_lineitem(spark, d):
    return L.coverage_points(S.table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_linestatus") == "F")


@query("SELECT region AS unit_id FROM (SELECT 'r' || r_regionkey AS region FROM region WHERE r_regionkey = 2 UNION SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 2)")
def unit_tree_region(spark, d):
    regions = S.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("unit_id"), F.lit(None).cast("string").alias("parent_id"))
    nations = S.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("unit_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    return L.unit_tree(regions.union(nations), regions.filter("unit_id = 'r2'").select("unit_id"))


@query("SELECT k AS item_id FROM (SELECT DISTINCT 'f' || (p_partkey % 10) AS k FROM part) WHERE k NOT IN ('f2', 'f5')")
def superseded_items_part(spark, d):
    items = S.table(spark, d, "part").select(F.concat(F.lit("f"), F.pmod("p_partkey", F.lit(10)).cast("string")).alias("item_id")).distinct()
    edges = spark.createDataFrame([("f2", "f3"), ("f5", "f9")], "old_id string, new_id string")
    return L.without_superseded(items, edges)


# Ingestion: a table laid out as the cells of a sheet, and read back as facts.


def _sheet(spark, d):
    """Suppliers as cells: key, name, balance (as text; the balance of every 11th is unreadable), nation."""
    s = S.table(spark, d, "supplier")
    balance = F.when(F.col("s_suppkey") % 11 == 0, "n.v.").when(F.col("s_suppkey") % 13 == 0, "#N/A").otherwise(S.decimal(F.col("s_acctbal")).cast("string"))
    cells = F.array(*[F.struct(F.lit(i).alias("col"), c.cast("string").alias("value")) for i, c in enumerate((F.col("s_suppkey") - F.pmod("s_suppkey", F.lit(2)), F.col("s_name"), balance, F.col("s_nationkey")), 1)])
    return s.select(S.file_of("supplier", F.col("s_suppkey"), 2).alias("item_id"), F.lit(0).alias("sheet"), (F.col("s_suppkey") + 1).cast("int").alias("row"), F.inline(cells))


def _supplier_facts(spark, d):
    from .operators.materialize import materialize

    maps = [(0, 1, "supplier.pair", "integer", True, True), (0, 2, "supplier.name", "text", True, False), (0, 3, "supplier.balance", "decimal", False, False), (0, 4, "supplier.nation", "integer", False, False)]
    return materialize(_sheet(spark, d), spark.createDataFrame(maps, "sheet int, col int, code string, data_type string, required boolean, identity boolean"), 1)


@query("SELECT 'supplier#' || (s_suppkey % 2) || ':s0:r' || (s_suppkey + 1) AS record_id, (s_suppkey + 1)::INT AS source_row, CASE WHEN s_suppkey % 11 = 0 THEN 'failed' ELSE 'passed' END AS quality_status FROM supplier")
def materialize_records_supplier(spark, d):
    return _supplier_facts(spark, d).records.select("record_id", "source_row", "quality_status")


@query("""SELECT code, COUNT(*) AS n, ROUND(SUM(CASE WHEN code = 'supplier.balance' AND s_suppkey % 13 <> 0 THEN s_acctbal END), 3) AS total FROM (SELECT *, unnest(['supplier.pair', 'supplier.name', 'supplier.balance', 'supplier.nation']) AS code FROM supplier)
WHERE code <> 'supplier.balance' OR s_suppkey % 11 <> 0 GROUP BY 1""")
def materialize_values_supplier(spark, d):
    return _supplier_facts(spark, d).values.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("decimal_value").cast("double"), 3).alias("total"))


@query("SELECT 'supplier#' || (s_suppkey % 2) || ':s0:r' || (s_suppkey + 1) AS record_id, 'normalization_failed' AS code, 'supplier.balance@C' || (s_suppkey + 1) AS detail FROM supplier WHERE s_suppkey % 11 = 0")
def materialize_issues_supplier(spark, d):
    return _supplier_facts(spark, d).issues


@query("SELECT v AS violation, 0::BIGINT AS n FROM (VALUES ('value_without_record'), ('value_without_lineage'), ('lineage_without_value'), ('duplicate_value')) t(v)")
def audit_supplier(spark, d):
    from .operators.materialize import audit

    return audit(_supplier_facts(spark, d))


@query("SELECT s_nationkey AS nation, MIN(s_suppkey) AS first, list_aggregate(list_sort(list(s_suppkey)), 'string_agg', ',') AS members FROM supplier GROUP BY 1")
def layout_cluster_supplier(spark, d):
    s = S.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
    return s.agg(F.min("s_suppkey").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT a.k, a.n AS place, a.o_orderkey AS x, b.o_orderkey AS y FROM (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') a JOIN (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k AND a.n = b.n")
def numbered_match_orders(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).select("k", "o_orderkey")
    from pyspark.sql import Window

    m = L.numbered_match(side("F"), side("O"), ["k"], "o_orderkey")
    return m.select("k", F.row_number().over(Window.partitionBy("k").orderBy("o_orderkey")).cast("long").alias("place"), F.col("o_orderkey").alias("x"), F.col("o_orderkey_right").alias("y"))


# Matching.


@query("""WITH a AS (SELECT p_partkey AS left_id, list_distinct(string_split(p_name, ' ')) AS x FROM part), b AS (SELECT MIN(p_type) AS right_id, list_sort(x) AS y FROM (SELECT p_type, list_distinct(string_split(p_type || ' ' || p_name, ' ')) AS x FROM part) GROUP BY list_sort(x)),
s AS (SELECT left_id, right_id, array_to_string(y, ' ') AS labels, CAST(round_even(10000.0 * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 0) AS BIGINT) AS score FROM a JOIN b ON len(list_intersect(x, y)) > 0)
SELECT left_id, labels, score FROM s QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, labels) = 1""")
def template_match_part(spark, d):
    """Every part's name against the distinct label sets of all parts' names and types: the nearest, met by its rarest labels."""
    from .operators.layers import best_covered, header_score

    none = F.struct(F.lit(None).cast("long").alias("columns"), F.lit(None).cast("long").alias("header_depth"), F.lit(None).cast("string").alias("kind")).alias("told")
    p = S.table(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("left_id"), F.split("p_name", " ").alias("keys"), none)
    sets = p.select(F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_name"), " "))).alias("keys")).distinct()
    right = sets.select(F.array_join("keys", " ").alias("right_id"), "keys", none)
    return best_covered(left, right, header_score, both=True).select("left_id", F.col("right_id").alias("labels"), "score")


@query("""WITH p AS (SELECT p_partkey AS left_id, p_brand, list_distinct(string_split(p_name, ' ')) AS x FROM part), b AS (SELECT p_brand AS right_id, list_distinct(flatten(list(x))) AS y FROM p GROUP BY 1),
s AS (SELECT left_id, right_id, CAST(round_even(10000.0 * len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 0) AS BIGINT) AS score FROM p JOIN b ON len(list_intersect(x, y)) > 0),
r AS (SELECT *, score - COALESCE(lead(score) OVER w, 0) AS lead, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, right_id))
SELECT left_id, right_id, score, lead, score >= 8500 AND lead >= 1500 AS exact FROM r WHERE n = 1""")
def template_match_part_brand(spark, d):
    """Every part against the labels of every brand; parts of one set of labels are matched once."""
    from .operators.matching import nearest_templates

    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("left_id"), "p_brand", F.split("p_name", " ").alias("labels"))
    brands = p.select(F.col("p_brand").alias("right_id"), F.explode("labels").alias("label")).groupBy("right_id").agg(F.collect_set("label").alias("labels"))
    return nearest_templates(p.select("left_id", "labels"), brands).select("left_id", "right_id", "score", "lead", "exact")


# Maintenance.


@query("WITH a AS (SELECT p_partkey AS k, p_size AS n FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey AS k, p_size + CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS n FROM part WHERE p_partkey % 5 <> 0) SELECT CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n THEN 'unchanged' ELSE 'updated' END AS action, COUNT(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def sync_counts_part(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    moved = p.filter("k % 5 <> 0").withColumn("n", F.col("n") + F.when(F.col("k") % 6 == 0, 1).otherwise(0))
    return M.sync(p.filter("k % 4 <> 0"), moved, ["k"], complete=True)[1]


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_versions_events(spark, d):
    return M.latest_versions(S.table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, p_size + p_partkey % 2 AS v FROM part WHERE p_partkey % 4 <> 0) SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'restore' WHEN a.v <> b.v THEN 'reimport' ELSE 'none' END AS action FROM a FULL JOIN b ON a.k = b.k")
def plan_difference_part(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return M.plan_difference(p.filter("k % 3 <> 0"), p.filter("k % 4 <> 0").withColumn("v", F.col("v") + F.col("k") % 2), "k", "v")


@query("SELECT 'orders' AS \"table\", COUNT(*) AS before, COUNT(*) FILTER (o_custkey % 11 = 0) AS deleted FROM orders UNION ALL SELECT 'customer', COUNT(*), COUNT(*) FILTER (c_custkey % 11 = 0) FROM customer")
def deletion_counts_orders(spark, d):
    tables = {"orders": S.table(spark, d, "orders"), "customer": S.table(spark, d, "customer")}
    gone = tables["customer"].filter("c_custkey % 11 = 0").select(F.col("c_custkey").alias("id"))
    return M.deletion(tables, {"orders": "o_custkey", "customer": "c_custkey"}, gone)[1]


STATE = "CASE o_orderstatus WHEN 'F' THEN 'imported' WHEN 'O' THEN 'needs_review' ELSE 'failed' END"


@query(f"WITH c AS (SELECT o_custkey AS batch_id, COUNT(*) AS total, COUNT(*) FILTER (s = 'imported') AS completed, COUNT(*) FILTER (s = 'needs_review') AS active, COUNT(*) FILTER (s = 'failed') AS failed FROM (SELECT o_custkey, {STATE} AS s FROM orders) GROUP BY 1) SELECT *, 0::BIGINT AS partial, 0::BIGINT AS deleted, CASE WHEN completed + failed = 0 THEN CASE WHEN active > 0 THEN 'running' ELSE 'pending' END WHEN completed + failed < total THEN 'running' WHEN failed = total THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def batch_status_orders(spark, d):
    items = S.table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.expr(STATE).alias("status"))
    return M.batch_status(items, items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total")))


@query("SELECT event_type, user_id % 10 AS bucket, COUNT(*) AS n, COUNT(*) FILTER (event_id % 9 <> 0) AS passed, COUNT(*) FILTER (event_id % 9 = 0) AS failed, MIN(event_id) AS first_row, MAX(event_id) AS last_row, MAX(ts) AS latest FROM events GROUP BY 1, 2")
def record_tree_events(spark, d):
    e = S.table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10).withColumn("quality_status", F.when(F.col("event_id") % 9 == 0, "failed").otherwise("passed"))
    return M.record_tree(e, ["event_type", "bucket"], "event_id", "ts")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def last_turns_conversations(spark, d):
    return M.last_turns(S.table(spark, d, "conversations"), 2, "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT lang AS value, COUNT(*) AS n FROM documents GROUP BY 1")
def histogram_documents(spark, d):
    return M.histogram(S.table(spark, d, "documents"), "lang")


@query("SELECT doc_id, sha256(text) AS digest, length(text)::BIGINT AS length FROM documents WHERE text IS NOT NULL")
def text_evidence_documents(spark, d):
    e = S.table(spark, d, "documents").filter("text is not null").select("doc_id", M.text_evidence(F.col("text")).alias("e"))
    return e.select("doc_id", F.col("e.sha256").alias("digest"), F.col("e.length").cast("long").alias("length"))


@query("SELECT p_partkey, CASE WHEN p_name = '' THEN '' ELSE '样例7-' || p_partkey || '-2' END AS name, (700000 + p_partkey * 100 + 3)::VARCHAR AS size FROM part")
def masking_part(spark, d):
    row = F.col("p_partkey").cast("int")
    mask = lambda c, kind, col: M.synthetic(F.col(c).cast("string"), F.lit(kind), F.lit(7), row, F.lit(col))
    return S.table(spark, d, "part").select("p_partkey", mask("p_name", "text", 2).alias("name"), mask("p_size", "integer", 3).alias("size"))


@query("SELECT o_custkey AS left_id, c_custkey AS right_id FROM (SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS bag FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) JOIN (SELECT o_custkey AS c_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS bag2 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON bag = bag2")
def same_fields_orders(spark, d):
    from .operators.fields import same_fields

    o = S.table(spark, d, "orders")
    side = lambda s, label: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias(label), F.col("o_orderpriority").alias("code"))
    return same_fields(side("F", "left_id"), side("P", "right_id"))


@query("WITH s AS (SELECT o_custkey AS template_id, o_orderkey, o_totalprice > 100000 AS required, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey AS template_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT COALESCE(s.template_id, a.template_id) AS template_id, s.o_orderkey AS slot_key, a.o_orderkey AS source_id, CASE WHEN s.n IS NULL THEN 'left_over' WHEN a.n IS NOT NULL THEN 'filled' WHEN s.required THEN 'missing' ELSE 'optional' END AS state FROM s FULL JOIN a ON s.template_id = a.template_id AND s.n = a.n")
def slot_coverage_orders(spark, d):
    from .operators.fields import slot_coverage

    o = S.table(spark, d, "orders")
    slots = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("template_id"), F.col("o_orderkey").alias("slot_key"), (F.col("o_totalprice") > 100000).alias("required"))
    return slot_coverage(slots, o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("template_id"), F.col("o_orderkey").alias("source_id")))
