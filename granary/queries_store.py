"""Queries over a stored fact set, its frozen scopes and catalog, contract tables, and ingestion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .functions import values as V
from .operators import listing as L
from .operators.materialize import Facts, audit_evidence, fact_set, raw_rows
from .operators.select import filtered, long_values, scoped
from .plans import governance as G
from .plans import scoping
from .plans.answers import Catalog, Safe, aggregate_records, catalog_with_evidence, rank_records, safe, safe_with_evidence, serialized
from .plans.contracts import Filter, Provenance, Scope
from .plans.guarded_sql import run as guarded
from .plans.lifecycle import transition
from .plans.lookup import households, source_rows
from .queries import ORDERS, _raw_parts, _sheet, _supplier_facts, real
from .registry import query
from .sources import facts as S
from .sources import store

# Orders in the store: two plans by year, and each order's clerk priority in a second role.
STORED = """st AS (
  SELECT o.*, COALESCE(c.c_nationkey, 0) AS unit, 'orders:' || o_orderkey AS record_id, 'orders#' || (o_orderkey % 4) AS item_id,
    CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,10)) AS price, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'plan:old' ELSE 'plan:new' END AS plan
  FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 0
)"""


def stored_orders(spark, d):
    """Orders written to a store by record type and plan, and read back."""
    facts = S.orders(spark, d)
    plan = F.when(F.col("created_at") < F.lit("1995-01-01").cast("timestamp"), "plan:old").otherwise("plan:new")
    path = store.work_dir(spark)
    store.write(facts.df.withColumn("approved_plan_id", plan), path)
    return store.read(spark, path, facts)


@query(f"WITH {STORED} SELECT o_orderstatus AS status, ROUND(CAST(SUM(price) AS DOUBLE), 4) AS value FROM st WHERE plan = 'plan:new' AND o_orderpriority = '1-URGENT' GROUP BY 1")
def stored_group_by_provenance(spark, d):
    facts = replace(stored_orders(spark, d), provenance=Provenance("approved_plan", "plan:new"))
    plan = Safe("group_by", filters=(Filter("orders.priority", "eq", "1-URGENT"),), group_by=("orders.status",), measure="orders.totalprice", aggregation="sum")
    return safe(facts, S.ALL, plan).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(f"WITH {STORED} SELECT o_orderstatus AS status, ROUND(CAST(MAX(price) AS DOUBLE), 6) AS value, (SELECT COUNT(*) FROM st) AS record_count, (SELECT COUNT(DISTINCT item_id) FROM st) AS source_file_count, (SELECT COUNT(DISTINCT unit) FROM st) AS unit_count FROM st GROUP BY 1")
def stored_answer_with_evidence(spark, d):
    return real(safe_with_evidence(stored_orders(spark, d), S.ALL, Safe("group_by", group_by=("orders.status",), measure="orders.totalprice", aggregation="max")), "value")


@query(f"WITH {ORDERS} SELECT o_orderkey::INT AS key, CAST(price AS VARCHAR) AS totalprice, record_id, item_id, (SELECT COUNT(*) FROM orders_f WHERE o_orderstatus = 'P') AS record_count, (SELECT COUNT(DISTINCT item_id) FROM orders_f WHERE o_orderstatus = 'P') AS source_file_count, (SELECT COUNT(DISTINCT unit) FROM orders_f WHERE o_orderstatus = 'P') AS unit_count FROM orders_f WHERE o_orderstatus = 'P' ORDER BY price DESC, record_id LIMIT 10")
def rank_with_evidence_serialized(spark, d):
    plan = Catalog("rank", ("orders.key",), (Filter("orders.status", "eq", "P"),), order_by="orders.totalprice", direction="desc", limit=10)
    return serialized(rank_records(S.orders(spark, d), S.ALL, plan))


@query(f"WITH {ORDERS} SELECT ROUND(CAST(AVG(price) AS DOUBLE), 4) AS value, COUNT(*) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count FROM orders_f WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def aggregate_with_evidence(spark, d):
    plan = Catalog("aggregate", filters=(Filter("orders.priority", "in", ["1-URGENT", "2-HIGH"]),), measure="orders.totalprice", aggregation="avg")
    return aggregate_records(S.orders(spark, d), S.ALL, plan).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("SELECT event_type AS value, COUNT(*) AS group_record_count, (SELECT COUNT(*) FROM events) AS record_count, 4::BIGINT AS source_file_count, 1::BIGINT AS unit_count FROM events GROUP BY 1")
def group_count_with_evidence(spark, d):
    return catalog_with_evidence(S.events(spark, d), S.ALL, Catalog("group_count", group_by="events.type"))


@query("SELECT COUNT(DISTINCT o_custkey) AS value FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderstatus = 'F'")
def safe_aggregate_count_distinct(spark, d):
    return safe(S.orders(spark, d), S.ALL, Safe("aggregate", filters=(Filter("orders.status", "eq", "F"),), measure="orders.customer", aggregation="count"))


@query(f"WITH {ORDERS} SELECT ROUND(CAST(MIN(price) AS DOUBLE), 6) AS value, COUNT(*) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count FROM orders_f")
def catalog_aggregate_ungrouped(spark, d):
    return real(aggregate_records(S.orders(spark, d), S.ALL, Catalog("aggregate", measure="orders.totalprice", aggregation="min")), "value")


# Roles.


def _with_roles(spark, d):
    """Parts whose size has a second role, `half`, for even sizes."""
    p = S.table(spark, d, "part")
    fields = {"size": ("integer", F.col("p_size")), "brand": ("text", F.col("p_brand"))}
    return S.wide(p, "part", F.col("p_partkey"), fields, F.lit(0), S.file_of("part", F.col("p_partkey")), F.lit("2024-01-01"), roles={("size", "half"): F.when(F.col("p_size") % 2 == 0, (F.col("p_size") / 2).cast("int"))}, dimensions=("part.size",))


@query("SELECT field_code, role, field_version, COUNT(*) AS n, SUM(v)::BIGINT AS total FROM (SELECT 'part.size' AS field_code, '' AS role, 1 AS field_version, p_size AS v FROM part UNION ALL SELECT 'part.size', 'half', 1, p_size // 2 FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'part.brand', '', 1, NULL FROM part) GROUP BY 1, 2, 3")
def role_values_part(spark, d):
    facts = _with_roles(spark, d)
    return long_values(facts, scoped(facts, S.ALL)).groupBy("field_code", "role", "field_version").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("integer_value").cast("long")).alias("total"))


@query("SELECT COUNT(*) AS n FROM part WHERE p_size = 10")
def role_filter_sees_the_canonical_value(spark, d):
    facts = _with_roles(spark, d)
    return filtered(scoped(facts, S.ALL), facts, [Filter("part.size", "eq", 10)]).agg(F.count(F.lit(1)).alias("n"))


# Frozen scopes and the catalog.

BEFORE = "1996-06-30 00:00:00"


def _frozen(spark, d, facts, selected=None):
    replaced = spark.createDataFrame([("orders#1", "orders#2", "1996-01-01"), ("orders#3", "orders#0", "1999-01-01"), ("orders#0", "orders#9", "1996-01-01")], "old_id string, new_id string, declared_at string")
    return scoping.freeze(facts.df, S.TENANT, S.ALL.units, BEFORE, replaced.withColumn("declared_at", F.col("declared_at").cast("timestamp")), selected)


@query("SELECT item_id, sha256('orders#0' || chr(10) || 'orders#2' || chr(10) || 'orders#3') AS fingerprint FROM (VALUES ('orders#0'), ('orders#2'), ('orders#3')) t(item_id)")
def freeze_scope_orders(spark, d):
    found = _frozen(spark, d, S.orders(spark, d))
    return found.items.withColumn("fingerprint", F.lit(found.fingerprint))


@query(f"WITH {ORDERS} SELECT o_orderstatus AS status, ROUND(CAST(SUM(price) AS DOUBLE), 4) AS value FROM orders_f WHERE o_orderdate <= TIMESTAMP '{BEFORE}' AND item_id <> 'orders#1' GROUP BY 1")
def safe_in_frozen_scope(spark, d):
    facts = stored_orders(spark, d)
    plan = Safe("group_by", group_by=("orders.status",), measure="orders.totalprice", aggregation="sum")
    return safe(facts, _frozen(spark, d, facts).scope, plan).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("SELECT 'orders#1' AS item_id")
def freeze_selected_item(spark, d):
    return _frozen(spark, d, S.orders(spark, d), "orders#1").items


def _catalog(spark, d):
    """Open orders have no field closed, so in their scope it is absent, and so is its metric."""
    orders = S.orders(spark, d)
    sets = [replace(orders, df=orders.df.filter(orders.value("orders.status") == "O")), S.part(spark, d), S.events(spark, d)]
    rows = [(c, 1, 2 if c == "part.size" else 1, c, None, k, None, [c.rpartition(".")[2]]) for f in sets for c, k in f.types.items()]
    versions = spark.createDataFrame(rows, "code string, version int, published_version int, name string, description string, data_type string, unit string, aliases array<string>")
    metrics = [("total", 1, "published", True, "orders", "orders.totalprice", ["orders.status"]), ("closed", 1, "published", True, "orders", "orders.closed", None), ("sizes", 1, "published", True, "part", "part.size", None), ("off", 1, "published", False, "part", "part.price", None), ("value", 3, "published", True, "events", "events.value", ["events.type"])]
    metrics = spark.createDataFrame(metrics, "code string, version int, status string, enabled boolean, fact_set_code string, field_code string, filter_fields array<string>")
    return scoping.build_catalog(sets, Scope(S.TENANT, S.ALL.units, before="1998-01-01 00:00:00"), versions, metrics)


@query(f"""WITH {ORDERS}, o AS (SELECT * FROM orders_f WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01'), e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '1998-01-01')
SELECT 'orders' AS code, COUNT(*) AS record_count, COUNT(DISTINCT item_id) AS source_file_count, COUNT(DISTINCT unit) AS unit_count, 'orders.customer|orders.date|orders.day|orders.key|orders.large|orders.priority|orders.status|orders.totalprice' AS field_codes FROM o HAVING COUNT(*) > 0
UNION ALL SELECT 'events', COUNT(*), COUNT(DISTINCT event_id % 4), 1, 'events.at|events.type|events.user|events.value' FROM e HAVING COUNT(*) > 0""")
def catalog_fact_sets(spark, d):
    found = _catalog(spark, d).fact_sets
    return found.select("code", "record_count", "source_file_count", "unit_count", F.array_join("field_codes", "|").alias("field_codes"))


@query("SELECT code FROM (VALUES ('total')) t(code) UNION ALL SELECT 'value' FROM (SELECT 1 FROM events WHERE ts <= TIMESTAMP '1998-01-01' LIMIT 1)")
def catalog_metrics(spark, d):
    return _catalog(spark, d).metrics.select("code")


@query("SELECT 'orders' AS code, 1::BIGINT AS matched_fact_sets, 8::BIGINT AS matched_fields, FALSE AS fact_sets_truncated, FALSE AS fields_truncated")
def describe_schema(spark, d):
    sets, _, told = scoping.describe(_catalog(spark, d), ["orders.status", "orders.totalprice"], "PRIOR")
    return sets.select("code").crossJoin(told)


@query(f"WITH {ORDERS} SELECT unit, COUNT(*) AS n FROM orders_f WHERE unit IN (3, 4) GROUP BY 1")
def role_scope_orders(spark, d):
    seen = scoping.role_scope(S.orders(spark, d).df.filter("quality_status = 'passed'"), "village_reader", S.TENANT, ["3", "4"], True)
    return seen.groupBy(F.col("unit_id").cast("int").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


# Contract tables: brands as fact sets, parts as metrics.


def _fact_set_drafts(spark, d):
    p = S.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("code"), F.lit(1).alias("version"), F.when(F.col("p_size") % 9 == 0, "published").otherwise("draft").alias("status"),
        F.when(F.col("p_size") % 7 == 0, "by_hand").when(F.col("p_size") % 2 == 0, "approved_plan").otherwise("document_template").alias("provenance_kind"),
        F.when(F.col("p_size") % 5 != 0, 1).alias("provenance_version"), F.when(F.col("p_size") % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("part.key"))).alias("identity"),
        F.when(F.col("p_size") % 11 == 0, F.array(F.lit("part.key"), F.lit("part.gone"))).otherwise(F.array(F.lit("part.size"))).alias("referenced"),
    )


PROBLEM = "CASE WHEN p_size % 9 = 0 THEN 'not_a_draft' WHEN p_size % 7 = 0 OR (p_size % 2 <> 0 AND p_size % 5 = 0) THEN 'bad_provenance' WHEN p_size % 11 = 0 THEN 'unpublished_fields' WHEN p_size % 8 = 0 THEN 'no_identity' END"


@query(f"SELECT p_partkey::VARCHAR AS code, {PROBLEM} AS problem, CASE WHEN {PROBLEM} IS NULL OR p_size % 9 = 0 THEN 'published' ELSE 'draft' END AS status FROM part")
def publish_fact_sets_part(spark, d):
    fields = spark.createDataFrame([("part.key",), ("part.size",)], "code string")
    return G.publish_fact_sets(_fact_set_drafts(spark, d), fields).select("code", "problem", "status")


@query("SELECT p_partkey AS code, CASE WHEN p_size % 9 = 0 THEN 'not_a_draft' WHEN p_size % 3 = 0 THEN 'fact_set_unpublished' WHEN p_size % 4 = 0 THEN 'other_fingerprint' WHEN p_size % 5 = 0 THEN 'root_entity_undeclared' WHEN p_size % 7 = 0 THEN 'no_join_depth' END AS problem FROM part")
def publish_manifests_part(spark, d):
    p = S.table(spark, d, "part")
    drafts = p.select(
        F.col("p_partkey").alias("code"), F.lit(1).alias("version"), F.when(F.col("p_size") % 9 == 0, "published").otherwise("draft").alias("status"), F.when(F.col("p_size") % 3 == 0, "none").otherwise("part").alias("fact_set_code"), F.lit(1).alias("fact_set_version"),
        F.when(F.col("p_size") % 4 == 0, "x").otherwise("f").alias("fingerprint"), F.array(F.lit("part")).alias("entities"), F.when(F.col("p_size") % 5 == 0, "nobody").otherwise("part").alias("root_entity"), F.lit(1).alias("n_relationships"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(1).alias("max_join_depth"),
    )
    return G.publish_manifests(drafts, spark.createDataFrame([("part", 1, "published", "f")], "code string, version int, status string, fingerprint string")).select("code", "problem")


@query("SELECT 'price' AS metric_code, 2 AS metric_version, ROUND(CAST(SUM(CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(38,10))) AS DOUBLE), 4) AS value, COUNT(*) AS record_count, COUNT(DISTINCT p_partkey % 4) AS source_file_count FROM part WHERE p_brand = 'Brand#12'")
def metric_by_code(spark, d):
    rows = [("price", 1, "published", True, "part", "part.price", "avg", ["part.brand"]), ("price", 2, "published", True, "part", "part.price", "sum", ["part.brand"]), ("price", 3, "draft", True, "part", "part.price", "max", ["part.brand"])]
    metrics = spark.createDataFrame(rows, "code string, version int, status string, enabled boolean, fact_set_code string, field_code string, aggregation string, filter_fields array<string>")
    found = G.run_metric(metrics, {"part": S.part(spark, d)}, S.ALL, "price", (Filter("part.brand", "eq", "Brand#12"),))
    return found.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("SELECT p_partkey AS code, CASE p_size % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'user_confirmed' WHEN 2 THEN 'admin_review' WHEN 3 THEN 'published' ELSE 'deprecated' END AS from_status, CASE WHEN p_size % 5 <> 0 THEN 'wrong_state' END AS problem FROM part")
def lifecycle_part(spark, d):
    names = F.array(*map(F.lit, ("draft", "user_confirmed", "admin_review", "published", "deprecated")))
    versions = S.table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.lit(1).alias("version"), F.element_at(names, (F.col("p_size") % 5 + 1).cast("int")).alias("status"))
    requests = versions.select("code", "version", F.lit("confirm").alias("action"), F.lit(None).cast("string").alias("comment"))
    return transition(versions, requests, versions.select("code", "version").limit(0))[1].select("code", "from_status", "problem")


# Guarded SQL: the columns of the views.


@query("SELECT administrative_unit, n, n_rows FROM (SELECT 'everywhere' AS administrative_unit, COUNT(*) AS n, COUNT(DISTINCT p_partkey) AS n_rows FROM part WHERE p_size > 40)")
def sql_units_and_rows(spark, d):
    text = "SELECT administrative_unit, COUNT(*) AS n, COUNT(DISTINCT source_row) AS n_rows FROM question_records r JOIN question_values v USING (record_id, administrative_unit) WHERE field_code = :code AND role = '' AND field_version = 1 AND integer_value > :least GROUP BY administrative_unit"
    return guarded(S.part(spark, d), S.ALL, text, {"code": "part.size", "least": 40})


@query("SELECT 'part:' || p_partkey AS record_id, 'C' || p_partkey AS coordinate, p_brand AS display_value, 'part#' || (p_partkey % 4) AS file_name FROM part ORDER BY 1 LIMIT 50")
def sql_lineage_and_sources(spark, d):
    text = "SELECT record_id, coordinate, display_value, file_name FROM question_lineage l JOIN question_sources s ON l.source_item_id = s.item_id WHERE field_code = 'part.brand' ORDER BY record_id"
    return guarded(S.part(spark, d), S.ALL, text)


# Households of several fact sets, raw rows by fields.


@query("SELECT 'customer:' || c_custkey AS record_id, c_name AS person, c_mktsegment AS segment FROM customer WHERE c_nationkey = 4 AND c_custkey <> (SELECT MIN(c_custkey) FROM customer WHERE c_nationkey = 4) UNION ALL SELECT 'customer:' || MIN(c_custkey), MIN_BY(c_name, c_custkey), NULL FROM customer WHERE c_nationkey = 4")
def households_of_two_sets(spark, d):
    """The second set shows heads only, and no segment; its rows replace the first's."""
    one = S.customer(spark, d)
    heads = replace(one, df=one.df.filter(one.value("customer.relation") == "户主"))
    keys = ("customer.household", "customer.person", "customer.relation")
    found = households([(one, *keys, ("customer.person", "customer.segment")), (heads, *keys, ("customer.person",))], S.ALL, "household_number", "H004", "members")
    return found.select("record_id", "person", "segment")


@query("SELECT 'part:' || p_partkey AS record_id, p_brand AS shown FROM part WHERE p_brand = 'Brand#13' AND p_size > 30 AND p_partkey % 4 = 1 ORDER BY 1 LIMIT 100")
def source_rows_by_fields(spark, d):
    scope = Scope(S.TENANT, S.ALL.units, ("part#1",))
    found = source_rows(_raw_parts(spark, d), scope, ["brand"], [("brand", "eq", "BRAND#13")], S.part(spark, d), (Filter("part.size", "gt", 30),), 100)
    return found.select("record_id", F.col("shown")[0]["value"].alias("shown"))


# Listings.


@query("SELECT o_orderkey, (SELECT COUNT(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def page_with_total_orders(spark, d):
    return L.page_with_total(S.table(spark, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], 40, 20).select("o_orderkey", "total")


@query("""WITH f AS (SELECT o_custkey, o_orderpriority AS fp, list_distinct(list(o_orderstatus)) AS h FROM orders GROUP BY 1, 2), x AS (SELECT fp, COUNT(*) AS n FROM f GROUP BY 1), u AS (SELECT fp, v, COUNT(*) AS k FROM (SELECT fp, unnest(h) AS v FROM f) GROUP BY 1, 2)
SELECT x.fp AS fingerprint, x.n, COALESCE(string_agg(v, '|' ORDER BY v) FILTER (k = x.n), '') AS common, string_agg(v, '|' ORDER BY v) AS "all" FROM x JOIN u ON u.fp = x.fp GROUP BY 1, 2""")
def layout_clusters_orders(spark, d):
    files = S.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderpriority").alias("fingerprint")).agg(F.collect_set("o_orderstatus").alias("headers"))
    return L.layout_clusters(files).select("fingerprint", "n", F.array_join("common", "|").alias("common"), F.array_join("all", "|").alias("all"))


@query("SELECT c_nationkey AS nation, COUNT(*) AS n, string_agg(c_mktsegment || ':' || k, '|' ORDER BY c_mktsegment) AS children FROM (SELECT c_nationkey, c_mktsegment, COUNT(*) AS k FROM customer GROUP BY 1, 2) GROUP BY 1".replace("COUNT(*) AS n,", "SUM(k)::BIGINT AS n,"))
def children_of_nations(spark, d):
    found = L.children(S.table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), ["nation"], "c_mktsegment")
    return found.select("nation", "n", F.array_join(F.transform("children", lambda c: F.concat(c["name"], F.lit(":"), c["n"])), "|").alias("children"))


@query("SELECT c_custkey AS place, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN 'duplicate' ELSE 'duplicate_' || (n - 1) END AS role, n > 1 AS review FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)")
def suffixed_roles_customer(spark, d):
    rows = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("region_id"), F.col("c_mktsegment").alias("code"), F.col("c_custkey").alias("place"), F.lit("").alias("role"), F.lit(None).cast("string").alias("base_role"), F.lit(False).alias("preferred"))
    return L.suffixed_roles(rows).select("place", "role", "review")


@query("WITH s AS (SELECT user_id % 50 AS k, COUNT(*) AS n, COUNT(DISTINCT event_id) AS r, MIN(event_id) AS lo, MAX(event_id) AS hi, COUNT(DISTINCT event_type) AS t FROM events GROUP BY 1) SELECT 'u' || k AS item_id, CASE WHEN k % 5 = 0 THEN 'other_rows' WHEN k % 7 = 0 THEN 'not_expected' ELSE 'identity_not_unique' END AS problem FROM s")
def bootstrap_problems_events(spark, d):
    e = S.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("item_id"), F.col("event_id").alias("record_id"), F.col("event_id").cast("int").alias("source_row"), F.lit("passed").alias("quality_status"), F.lit("t").alias("template_id"), F.lit(1).alias("template_version"), "event_type", (F.col("user_id") % 50).alias("k"))
    expected = e.groupBy("item_id", "k").agg(F.count(F.lit(1)).alias("records"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"))
    expected = expected.filter("k % 7 <> 0 or k % 5 = 0").withColumn("records", F.col("records") + F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    return L.bootstrap_problems(L.source_summary(e, F.lit("same")), expected.drop("k"))


# Materialization: faults planted into stored tables.


@query("""SELECT * FROM (SELECT 'value_without_record' AS violation, SUM(4 - CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END - CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END) FILTER (s_suppkey % 10 = 0)::BIGINT AS n FROM supplier
UNION ALL SELECT 'value_without_lineage', COUNT(*) FILTER (s_suppkey % 6 = 0) FROM supplier UNION ALL SELECT 'lineage_without_value', COUNT(*) FILTER (s_suppkey % 8 = 0) FROM supplier
UNION ALL SELECT 'duplicate_value', COUNT(*) FILTER (s_suppkey % 9 = 0) FROM supplier)""")
def audit_planted_supplier(spark, d):
    from .operators.materialize import audit

    return audit(_planted(spark, d))


def _planted(spark, d):
    """The suppliers' facts as stored tables: names without lineage, nations without value, keys twice, records gone."""
    facts = _supplier_facts(spark, d)
    row = F.regexp_extract("record_id", r"(\d+)$", 1).cast("int") - 1
    path = store.work_dir(spark)
    lineage = facts.lineage.filter(~((row % 6 == 0) & (F.col("code") == "supplier.name")))
    values = facts.values.filter(~((row % 8 == 0) & (F.col("code") == "supplier.nation")))
    values = values.unionByName(values.filter((row % 9 == 0) & (F.col("code") == "supplier.pair")))
    tables = {"records": facts.records.filter(row % 10 != 0), "values": values, "lineage": lineage, "issues": facts.issues}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    return Facts(*[spark.read.parquet(f"{path}/{name}") for name in tables])


@query("""WITH s AS (SELECT *, s_suppkey % 11 = 0 AS bad FROM supplier)
SELECT * FROM (SELECT 'value_without_record' AS violation, 0::BIGINT AS n UNION ALL SELECT 'value_without_lineage', 0 UNION ALL SELECT 'lineage_without_value', 0 UNION ALL SELECT 'duplicate_value', 0
UNION ALL SELECT 'lineage_of_other_item', COUNT(*) FILTER (s_suppkey % 6 = 0) FROM s UNION ALL SELECT 'lineage_of_other_row', COUNT(*) FILTER (s_suppkey % 7 = 0) FROM s
UNION ALL SELECT 'raw_cell_missing', COUNT(*) FILTER (s_suppkey % 6 = 0 OR s_suppkey % 7 = 0) FROM s
UNION ALL SELECT 'raw_value_differs', COUNT(*) FILTER (s_suppkey % 10 = 0) FROM s UNION ALL SELECT 'value_not_of_raw', COUNT(*) FILTER (s_suppkey % 10 = 0) + COUNT(*) FILTER (s_suppkey % 9 = 0 AND s_suppkey % 10 <> 0) FROM s)""")
def audit_evidence_supplier(spark, d):
    """Planted: names' lineage moved to another item, or to a row that isn't there, nations' raw value changed, nations' typed value changed."""
    facts = _supplier_facts(spark, d)
    row = F.regexp_extract("record_id", r"(\d+)$", 1).cast("int") - 1
    name, nation = F.col("code") == "supplier.name", F.col("code") == "supplier.nation"
    path = store.work_dir(spark)
    lineage = facts.lineage.withColumn("item_id", F.when(name & (row % 6 == 0), "elsewhere").otherwise(F.col("item_id")))
    lineage = lineage.withColumn("coordinate", F.when(name & (row % 7 == 0), "B999999").otherwise(F.col("coordinate"))).withColumn("raw_value", F.when(nation & (row % 10 == 0), "777").otherwise(F.col("raw_value")))
    values = facts.values.withColumn("integer_value", F.when(nation & (row % 9 == 0), F.col("integer_value") + 100).otherwise(F.col("integer_value")))
    tables = {"records": facts.records, "values": values, "lineage": lineage, "issues": facts.issues}
    for label, df in tables.items():
        df.write.parquet(f"{path}/{label}")
    headers = spark.createDataFrame([(0, 1, ["key"])], "sheet int, col int, header_path array<string>")
    return audit_evidence(Facts(*[spark.read.parquet(f"{path}/{label}") for label in tables]), raw_rows(_sheet(spark, d), headers))


@query("SELECT SUM(CASE WHEN s_suppkey % 11 <> 0 THEN s_nationkey END)::BIGINT AS value, COUNT(*) FILTER (s_suppkey % 11 <> 0) AS record_count, COUNT(DISTINCT CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 2 END) AS source_file_count FROM supplier")
def metric_over_materialized(spark, d):
    from .plans.answers import metric
    from .plans.contracts import Measure

    items = S.table(spark, d, "supplier").select(S.file_of("supplier", F.col("s_suppkey"), 2).alias("item_id")).distinct()
    items = items.withColumns({"tenant_id": F.lit(S.TENANT), "unit_id": F.lit("0"), "created_at": F.lit("2024-01-01").cast("timestamp"), "template_id": F.lit("t"), "template_version": F.lit(1), "approved_plan_id": F.lit("p"), "file_name": F.col("item_id"), "relative_path": F.col("item_id"), "source_sha256": F.sha2("item_id", 256)})
    types = {"supplier.pair": "integer", "supplier.name": "text", "supplier.balance": "decimal", "supplier.nation": "integer"}
    facts = fact_set(_supplier_facts(spark, d), "supplier", types, items, measures={"supplier.nation": Measure(("sum",))})
    return metric(facts, S.ALL, "sum", "supplier.nation")


@query(r"""SELECT doc_id, CASE WHEN COALESCE(t, '') = '' THEN 'empty' WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7 THEN 'identifier_like' WHEN regexp_full_match(t, '\d{4}[-/.年]\d{1,2}([-/.月]\d{1,2}日?)?') THEN 'date_like'
  WHEN regexp_matches(t, '[一-鿿]') THEN 'cn_text' WHEN regexp_matches(t, '[A-Za-z]') THEN 'latin_text' ELSE 'text' END AS kind FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def redaction_documents(spark, d):
    return S.table(spark, d, "documents").select("doc_id", V.redact(F.col("text"))["kind"].alias("kind"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, CASE WHEN event_type IN ('error', 'view') THEN 'empty' ELSE NULL END AS reason FROM events")
def accepted_results_events(spark, d):
    """Props are JSON; errors and views stand for runs without rows."""
    e = S.table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.lit("success").alias("status"), F.when(F.col("event_type").isin("error", "view"), 0).otherwise(1).alias("n_rows"), F.lit("fact").alias("grade"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return G.accepted_results(runs).select(F.col("run_id").alias("event_id"), "k", "reason")


# Operators that no plan reaches.


@query(r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]+)$', 1), '\.[A-Za-z0-9]{1,5}$', ''), '\s+', '', 'g')) AS file_key FROM pages")
def file_key_pages(spark, d):
    return S.table(spark, d, "pages").select("page_id", V.file_key(F.col("url")).alias("file_key"))


@query(r"SELECT substr(sha256(k), 1, 16) AS case_id, MIN(text) AS question, COUNT(DISTINCT (role, turn)) AS n_places FROM (SELECT text, role, turn, regexp_replace(text, '\s+', '', 'g') AS k FROM conversations) WHERE k <> '' GROUP BY k")
def distinct_questions_conversations(spark, d):
    from .operators.matching import distinct_questions

    rows = S.table(spark, d, "conversations").select(F.col("text").alias("question"), F.col("role").alias("sheet"), F.col("turn").alias("row")).distinct()
    return distinct_questions(rows).select("case_id", "question", F.size("occurrences").cast("long").alias("n_places"))


@query("""SELECT sha, MAX_BY(value, event_id) AS value FROM (SELECT event_id, user_id::VARCHAR AS sha, '{"sha":"' || user_id || '","n":' || event_id || '}' AS value FROM events WHERE event_id % 7 <> 0) GROUP BY 1""")
def last_lines_events(spark, d):
    """Every seventh line was cut off while it was written."""
    from .operators.maintenance import last_lines

    whole = F.concat(F.lit('{"sha":"'), "user_id", F.lit('","n":'), "event_id", F.lit("}"))
    lines = S.table(spark, d, "events").select(F.col("event_id").alias("line"), F.when(F.col("event_id") % 7 == 0, F.lit('{"sha":"x')).otherwise(whole).alias("value"))
    return last_lines(lines)


@query("SELECT p_partkey AS code, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS published_version FROM part")
def restore_published_part(spark, d):
    from .operators.maintenance import restore_published

    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("code"), (F.col("p_size") + 1).alias("published_version"))
    return restore_published(p, p.filter("code % 3 <> 0").withColumn("published_version", F.col("published_version") - 1))


@query("SELECT user_id, CASE WHEN len(k) = 1 THEN k[1] WHEN list_has(k, 'text') OR list_has(k, 'date') THEN 'text' ELSE 'decimal' END AS kind FROM (SELECT user_id, list_distinct(list(CASE event_type WHEN 'view' THEN 'integer' WHEN 'click' THEN 'decimal' WHEN 'error' THEN 'text' ELSE 'date' END)) AS k FROM events GROUP BY 1)")
def observed_type_events(spark, d):
    from .operators.fields import observed_type

    kind = F.when(F.col("event_type") == "view", "integer").when(F.col("event_type") == "click", "decimal").when(F.col("event_type") == "error", "text").otherwise("date")
    return S.table(spark, d, "events").groupBy("user_id").agg(observed_type(F.collect_set(kind)).alias("kind"))


@query("SELECT * FROM nation")
def bundle_round_trip_nation(spark, d):
    from .operators.maintenance import export_bundle, import_bundle

    path = store.work_dir(spark)
    export_bundle({"nation": S.table(spark, d, "nation"), "region": S.table(spark, d, "region")}, path)
    return import_bundle(spark, path)["nation"]


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS label, CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE 'A' || chr(38 + p_size) END AS letters FROM part")
def label_keys_part(spark, d):
    from .functions.headers import label_key

    return S.table(spark, d, "part").select("p_partkey", label_key(F.col("p_name")).alias("label"), V.column_letters(F.col("p_size")).alias("letters"))


@query("""WITH w AS (SELECT c_custkey AS k, c_nationkey AS u, lead(c_custkey) OVER (ORDER BY c_custkey) AS n, lead(c_nationkey) OVER (ORDER BY c_custkey) AS nu FROM customer)
SELECT k AS old_id, k + 1 AS new_id, CASE WHEN n IS NULL THEN 'unknown_item' WHEN u = 3 OR nu = 3 THEN 'outside_scope' WHEN u <> nu THEN 'other_unit' WHEN k % 5 = 0 OR (k + 1) % 5 = 0 THEN 'no_passed_records' WHEN k % 6 = 0 THEN 'already_declared' END AS problem FROM w""")
def supersession_problems_customer(spark, d):
    from .plans.lifecycle import supersession_problems

    c = S.table(spark, d, "customer")
    items = c.select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").cast("string").alias("unit_id"), F.timestamp_seconds(F.col("c_custkey")).alias("created_at"))
    records = c.select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 5 == 0, "failed").otherwise("passed").alias("quality_status"))
    pairs = c.select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1).alias("new_id"))
    return supersession_problems(items, records, pairs.filter("old_id % 6 = 0"), pairs, [str(i) for i in range(25) if i != 3])


def _brand_sheets(spark, d):
    """A sheet for each brand: a header, its parts, and beside them a column of formulas only."""
    from pyspark.sql import Window

    p = S.table(spark, d, "part").withColumn("row", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1)
    cell = lambda col, value, formula: F.struct(F.lit(col).alias("col"), value.cast("string").alias("value"), formula.alias("formula"))
    no = F.lit(None).cast("string")
    body = p.select("p_brand", "row", F.inline(F.array(cell(1, F.col("p_name"), no), cell(2, F.col("p_size"), no), cell(4, F.col("p_size") * 2, F.concat(F.lit("=B"), "row", F.lit("*2"))))))
    head = p.select("p_brand").distinct().select("p_brand", F.lit(1).alias("row"), F.inline(F.array(cell(1, F.lit("Name"), no), cell(2, F.lit("Size"), no))))
    return body.unionByName(head).select(F.col("p_brand").alias("workbook_id"), F.lit(0).alias("sheet"), "row", "col", "value", "formula", no.alias("error"))


@query('SELECT p_brand AS workbook_id, 1 AS top, 1 AS "left", (COUNT(*) + 1)::INT AS bottom, 2 AS "right", (2 * COUNT(*) + 2)::INT AS n_cells FROM part GROUP BY 1')
def regions_of_brands(spark, d):
    from .operators.regions import find_regions, without_formulas_only

    cells = _brand_sheets(spark, d)
    return without_formulas_only(find_regions(cells), cells).select("workbook_id", "top", "left", "bottom", "right", "n_cells")


@query("SELECT DISTINCT p_brand AS workbook_id, 1 AS start, 1 AS depth, 'Name|Size' AS paths FROM part")
def headers_of_brands(spark, d):
    from .operators.regions import best_headers, find_regions, header_candidates, without_formulas_only

    cells = _brand_sheets(spark, d)
    found = best_headers(header_candidates(cells, without_formulas_only(find_regions(cells), cells)))
    return found.select("workbook_id", "start", "depth", F.array_join(F.transform("columns", lambda c: c["path"]), "|").alias("paths"))
