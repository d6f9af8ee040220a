"""Queries by the layers of template matching: headers, compositions of sheets, routes of workbooks; and by the approval of plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import layers as T
from .plans.approval import approve
from .registry import query
from .sources import facts as S
from .sources.work import written

# Orders as regions with two candidate headers: all taxes and flags of their lines, or the taxes alone.
# Header sets that eight orders or more have are published.
HEADERS = """l AS (SELECT *, 't' || CAST(round(l_tax * 100) AS INT) AS tax FROM lineitem), o AS (
  SELECT o_orderkey AS region_id, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS depth, COUNT(*) AS columns, list_sort(list_distinct(list(tax))) AS taxes,
    list_sort(list_distinct(list_concat(list(tax), list(l_returnflag || l_linestatus)))) AS every
  FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY ALL
), h AS (
  SELECT region_id, region_id || ':1' AS header_id, kind, columns, depth, every AS labels, 0.8 AS confidence, TRUE AS is_default, 1 AS header_rows FROM o
  UNION ALL SELECT region_id, region_id || ':2', kind, columns, depth, taxes, 0.9, FALSE, 2 FROM o
), v AS (
  SELECT array_to_string(labels, ',') AS version_id, labels, MIN(columns) AS columns, MIN(depth) AS depth, MIN(kind) AS kind FROM h GROUP BY labels HAVING COUNT(*) >= 8
)"""


def _tax():
    return F.concat(F.lit("t"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))


def _headers(spark, d):
    flag = F.concat("l_returnflag", "l_linestatus")
    per = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("columns"), F.array_sort(F.collect_set(_tax())).alias("taxes"), F.array_sort(F.array_union(F.collect_set(_tax()), F.collect_set(flag))).alias("both"))
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("region_id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("header_depth"))
    o = orders.join(per, orders["region_id"] == per["l_orderkey"])
    each = F.inline(F.array(
        F.struct(F.lit(1).alias("n"), F.col("both").alias("labels"), F.lit(0.8).alias("confidence"), F.lit(True).alias("is_default"), F.lit(1).alias("header_rows")),
        F.struct(F.lit(2).alias("n"), F.col("taxes").alias("labels"), F.lit(0.9).alias("confidence"), F.lit(False).alias("is_default"), F.lit(2).alias("header_rows")),
    ))
    h = o.select("region_id", "kind", "columns", "header_depth", each)
    h = h.withColumns({"header_id": F.concat_ws(":", F.col("region_id"), F.col("n")), "fingerprint": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "column_ids": F.array().cast("array<string>")})
    h = written(h)
    v = h.groupBy("labels").agg(F.count(F.lit(1)).alias("n"), F.min("columns").alias("columns"), F.min("header_depth").alias("header_depth"), F.min("kind").alias("kind")).filter("n >= 8")
    v = v.select(F.array_join("labels", ",").alias("version_id"), "labels", "columns", "header_depth", "kind", F.lit(None).cast("string").alias("fingerprint"), F.lit(False).alias("validated"), F.array().cast("array<string>").alias("bound"))
    return h, written(v)


@query(f"""WITH {HEADERS}, m AS (
  SELECT region_id, header_id, confidence, is_default, header_rows, version_id, len(list_intersect(h.labels, v.labels)) AS shared, len(h.labels) AS a, len(v.labels) AS b,
    (h.columns <> v.columns)::INT + (len(list_intersect(h.labels, v.labels)) < greatest(len(h.labels), len(v.labels)) AND h.depth <> v.depth)::INT + (h.kind <> v.kind)::INT AS off
  FROM h JOIN v ON len(list_intersect(h.labels, v.labels)) > 0
), s AS (SELECT *, greatest(0, CAST(round_even(10000.0 * shared / (a + b - shared), 0) AS BIGINT) - 750 * off) AS score FROM m),
t AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY header_id ORDER BY score DESC, version_id) = 1),
c AS (SELECT h.region_id, h.header_id, version_id, COALESCE(score, 0) AS score FROM h LEFT JOIN t USING (header_id) QUALIFY row_number() OVER (PARTITION BY h.region_id ORDER BY COALESCE(score, 0) DESC, h.confidence DESC, h.is_default DESC, h.header_rows) = 1)
SELECT region_id, header_id, version_id, score, CASE WHEN score = 10000 THEN 'exact' WHEN score > 0 THEN 'partial' ELSE 'none' END AS match_type FROM c""")
def region_templates_orders(spark, d):
    h, v = _headers(spark, d)
    none = spark.createDataFrame([], "version_id string, source string, region_id long")
    return T.match_regions(T.best_headers(h, v, none), v, none).select("region_id", "header_id", "version_id", "score", "match_type")


# Orders as sheets, their lines as regions of the template that is their tax. Multisets of taxes that twenty
# orders or more have are published compositions, with a slot for each line; the first two are required.
COMPOSED = """p AS (SELECT l_orderkey AS owner_id, 't' || CAST(round(l_tax * 100) AS INT) AS member, l_linenumber AS part_id FROM lineitem),
n AS (SELECT *, member || '#' || row_number() OVER (PARTITION BY owner_id, member ORDER BY part_id) AS key FROM p),
a AS (SELECT owner_id, list_sort(list(key)) AS keys, array_to_string(list_sort(list(member)), '+') AS entry_id FROM n GROUP BY 1),
e AS (SELECT entry_id, keys FROM a GROUP BY ALL HAVING COUNT(*) >= 20),
sl AS (SELECT entry_id, unnest(string_split(entry_id, '+')) AS member, generate_subscripts(string_split(entry_id, '+'), 1) AS ordinal FROM e),
sk AS (SELECT *, member || '#' || row_number() OVER (PARTITION BY entry_id, member ORDER BY ordinal) AS key FROM sl),
sc AS (SELECT owner_id, a.keys, e.entry_id, e.keys AS slots, len(list_intersect(a.keys, e.keys)) AS shared FROM a JOIN e ON len(list_intersect(a.keys, e.keys)) > 0),
sb AS (SELECT *, greatest(0, CAST(round_even(10000.0 * shared / len(slots), 0) AS BIGINT) - 500 * (len(keys) - shared)) AS score FROM sc),
top AS (SELECT * FROM sb WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, entry_id) = 1),
miss AS (SELECT owner_id, COUNT(*) AS missing FROM top JOIN sk USING (entry_id) WHERE ordinal <= 2 AND NOT list_contains(top.keys, key) GROUP BY 1),
sheet AS (
  SELECT a.owner_id, top.entry_id, COALESCE(score, 0) AS score, COALESCE(shared, 0)::BIGINT AS matched_slots, COALESCE(missing, 0) AS missing, (len(a.keys) - COALESCE(shared, 0))::BIGINT AS unknown,
    CASE WHEN shared = len(slots) AND shared = len(a.keys) THEN 'exact' WHEN score > 0 THEN 'partial' ELSE 'none' END AS match_type
  FROM a LEFT JOIN top USING (owner_id) LEFT JOIN miss USING (owner_id)
)"""


def _compositions(spark, d):
    members = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner_id"), _tax().alias("member"), F.col("l_linenumber").alias("part_id"))
    had = members.groupBy("owner_id").agg(F.array_sort(F.collect_list("member")).alias("members"))
    common = had.groupBy("members").count().filter("count >= 20")
    slots = common.select(F.array_join("members", "+").alias("entry_id"), F.posexplode("members").alias("at", "member"))
    ordinal = F.col("at") + 1
    return members, slots.select("entry_id", F.concat(F.lit("slot"), ordinal.cast("string")).alias("slot_key"), ordinal.alias("ordinal"), "member", (ordinal <= 2).alias("required"), F.lit(True).alias("materialize"))


@query(f"WITH {COMPOSED} SELECT * FROM sheet")
def sheet_compositions_orders(spark, d):
    members, slots = _compositions(spark, d)
    table = T.match_slots(members, members, slots)[0]
    sizes = {c: F.size(c).cast("long") for c in ("missing", "unknown")}
    return table.withColumns(sizes).select("owner_id", "entry_id", "score", "matched_slots", "missing", "unknown", "match_type")


# Customers as workbooks, their orders as sheets, and for each nation a route of the four compositions that most of its orders have exactly.
@query(f"""WITH {COMPOSED}, x AS (SELECT o_custkey AS owner_id, c_nationkey AS nation, s.entry_id AS member, o_orderkey AS part_id FROM sheet s JOIN orders ON o_orderkey = owner_id JOIN customer ON c_custkey = o_custkey WHERE match_type = 'exact'),
r AS (SELECT nation, member FROM x GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY nation ORDER BY COUNT(*) DESC, member) <= 4),
rk AS (SELECT 'nation' || lpad(nation::VARCHAR, 2, '0') AS route, list(member || '#1') AS slots FROM r GROUP BY 1),
xk AS (SELECT owner_id, list(member || '#' || n) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, member ORDER BY part_id) AS n FROM x) GROUP BY 1),
b AS (SELECT owner_id, route, len(list_intersect(keys, slots)) AS shared, greatest(0, CAST(round_even(10000.0 * len(list_intersect(keys, slots)) / len(slots), 0) AS BIGINT) - 500 * (len(keys) - len(list_intersect(keys, slots)))) AS score FROM xk JOIN rk ON len(list_intersect(keys, slots)) > 0),
t AS (SELECT * FROM b WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, route) = 1)
SELECT c_custkey AS owner_id, route AS entry_id, COALESCE(score, 0) AS score, COALESCE(shared, 0)::BIGINT AS matched_slots, COALESCE(CAST(round_even(10000.0 * shared / len(slots), 0) AS BIGINT), 0) AS coverage
FROM customer LEFT JOIN t ON owner_id = c_custkey LEFT JOIN rk USING (route)""")
def workbook_routes_customers(spark, d):
    members, slots = _compositions(spark, d)
    sheets = written(T.match_slots(members, members, slots)[0].filter("match_type = 'exact'").select(F.col("owner_id").alias("part_id"), F.col("entry_id").alias("member")))
    orders = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("part_id"), F.col("o_custkey").alias("owner_id"))
    customers = S.table(spark, d, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_nationkey").alias("nation"))
    had = written(sheets.join(orders, "part_id").join(customers, "owner_id"))
    used = had.groupBy("nation", "member").agg(F.count(F.lit(1)).alias("n"))
    top = T.best(used, ["nation"], [F.col("n").desc(), F.col("member")], 4)
    route = F.concat(F.lit("nation"), F.lpad(F.col("nation").cast("string"), 2, "0"))
    routes = top.select(route.alias("entry_id"), F.col("member").alias("slot_key"), F.lit(1).alias("ordinal"), "member", F.lit(True).alias("required"), F.lit(True).alias("materialize"))
    return T.match_slots(customers, had.select("owner_id", "member", "part_id"), routes)[0].select("owner_id", "entry_id", "score", "matched_slots", "coverage")


# Orders as requests for plans of their customers' files, lines as regions, and a plan for each customer with an old finished order.
APPROVAL = """g AS (
  SELECT l_orderkey AS plan_id, concat_ws('/', l_linenumber, l_partkey, l_suppkey) AS region_id, l_linestatus AS header_id, l_returnflag AS sheet, CASE WHEN l_returnflag = 'N' AND l_tax < 0.005 THEN 'open' ELSE 'reused' END AS origin,
    l_quantity > 5 AS materialize, EXTRACT(day FROM l_shipdate) AS top, EXTRACT(day FROM l_shipdate) + l_quantity::INT % 5 AS bottom, l_partkey % 20 AS lft, l_partkey % 20 + l_suppkey % 5 AS rgt
  FROM lineitem
), act AS (SELECT DISTINCT * FROM g WHERE materialize AND origin <> 'open'),
crossing AS (SELECT DISTINCT a.plan_id FROM act a JOIN act b ON a.plan_id = b.plan_id AND a.sheet = b.sheet AND a.region_id < b.region_id AND a.top <= b.bottom AND b.top <= a.bottom AND a.lft <= b.rgt AND b.lft <= a.rgt),
told AS (SELECT plan_id, COUNT(*) AS n, COUNT(*) FILTER (origin = 'open') AS n_open, COUNT(*) FILTER (materialize AND origin <> 'open' AND header_id = 'O') AS homeless FROM (SELECT DISTINCT * FROM g) GROUP BY 1),
latest AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1993-01-01' GROUP BY 1)"""


@query(f"""WITH {APPROVAL} SELECT o_orderkey AS plan_id, CASE WHEN c_custkey IS NULL THEN 'unknown_item' WHEN c_acctbal < 0 THEN 'item_deleted' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown_source'
  WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'template_unavailable' WHEN COALESCE(n, 0) <> 3 THEN 'regions_differ' WHEN n_open > 0 THEN 'regions_open' WHEN homeless > 0 THEN 'header_of_other_region'
  WHEN crossing.plan_id IS NOT NULL THEN 'ranges_overlap' WHEN latest.o_custkey IS NOT NULL THEN 'latest_not_superseded' END AS problem
FROM orders LEFT JOIN customer ON c_custkey = orders.o_custkey LEFT JOIN told ON told.plan_id = o_orderkey LEFT JOIN crossing ON crossing.plan_id = o_orderkey LEFT JOIN latest ON latest.o_custkey = orders.o_custkey""")
def plan_approvals_orders(spark, d):
    orders, customers = S.table(spark, d, "orders"), S.table(spark, d, "customer")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    source = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "guess").when(F.col("o_orderpriority") == "5-LOW", "proposed").otherwise("template")
    requests = orders.select(F.col("o_orderkey").alias("plan_id"), text("o_custkey").alias("item_id"), source.alias("source"), F.col("o_orderstatus").alias("template_id"), F.lit(1).alias("template_version"), none.alias("proposal_id"), F.lit(None).cast("long").alias("supersedes"), text("o_orderkey").alias("digest"))
    items = customers.select(text("c_custkey").alias("item_id"), (F.col("c_acctbal") >= 0).alias("active"), F.lit(3).alias("total_regions"))
    templates = orders.select(F.col("o_orderstatus").alias("template_id")).distinct().select("template_id", F.lit(1).alias("version"), F.when(F.col("template_id") == "P", "draft").otherwise("published").alias("status"), F.lit(False).alias("retired"), none.alias("proposal_id"))
    proposals = items.select(none.alias("proposal_id"), "item_id", none.alias("status"), F.lit(False).alias("retired")).filter("proposal_id is not null")
    day, left = F.dayofmonth("l_shipdate"), F.col("l_partkey") % 20
    regions = S.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("region_id"), F.col("l_linestatus").alias("header_id"), F.col("l_returnflag").alias("sheet"),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") < 0.005), "open").otherwise("reused").alias("origin"), (F.col("l_quantity") > 5).alias("materialize"),
        day.alias("data_top"), (day + F.col("l_quantity").cast("int") % 5).alias("data_bottom"), left.alias("data_left"), (left + F.col("l_suppkey") % 5).alias("data_right"),
    ).distinct()
    regions = written(regions)
    headers = regions.filter("header_id = 'F'").select("region_id", "header_id")
    old = orders.filter("o_orderstatus = 'F' and o_orderdate < timestamp '1993-01-01'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("plan_id"))
    plans = old.select("plan_id", text("o_custkey").alias("item_id"), F.lit(1).alias("revision"), F.lit("template").alias("source"), F.lit("F").alias("template_id"), F.lit(1).alias("template_version"), none.alias("proposal_id"), F.lit("old").alias("digest"), F.lit("completed").alias("status"))
    return approve(requests, items, templates, proposals, regions, headers, plans).select("plan_id", "problem")


# Fields that parts' names teach, if a part were a decision about its type, taken in a file of its brand.
@query("""WITH a AS (SELECT p_type AS code, 'alias' AS kind, p_name AS alias, NULL AS role, COUNT(DISTINCT p_brand) AS support, MIN(p_partkey) AS first_decision FROM part GROUP BY 1, 3),
b AS (SELECT p_type AS code, 'role_context' AS kind, NULL AS alias, 'large' AS role, COUNT(DISTINCT p_brand) AS support, MIN(p_partkey) AS first_decision FROM part WHERE p_size > 25 GROUP BY 1)
SELECT a.*, (SELECT COUNT(DISTINCT p_type) - 1 FROM part WHERE p_name = a.alias) AS conflicts FROM a UNION ALL SELECT *, 0 FROM b""")
def learned_variants_part(spark, d):
    from .plans.learning import learned_variants

    p = S.table(spark, d, "part")
    said = p.select(
        F.col("p_partkey").alias("decision_id"), F.col("p_brand").alias("item_id"), F.col("p_type").alias("code"), F.array().cast("array<string>").alias("header_path"), F.when(F.col("p_size") > 25, "large").alias("role"),
        F.col("p_name").alias("learn_alias"), F.lit(False).alias("learn_path"), F.lit("parts").alias("domain"), F.lit("part").alias("record_type"), F.lit("text").alias("observed_type"), F.lit(None).cast("string").alias("unit"),
    )
    return learned_variants(said).select("code", "kind", "alias", "role", "support", "first_decision", "conflicts")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn END AS v, CASE WHEN role = 'user' THEN turn END AS r FROM conversations), s AS (SELECT *, COUNT(v) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM m)
SELECT conv_id, turn, COALESCE(last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1)::BIGINT AS village, COALESCE(last_value(r IGNORE NULLS) OVER (PARTITION BY conv_id, n ORDER BY turn), -1)::BIGINT AS reference FROM s""")
def fill_two_levels_conversations(spark, d):
    from .operators.listing import fill_down_within

    c = S.table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("v"), F.when(F.col("role") == "user", F.col("turn")).alias("r"))
    none = F.lit(-1).cast("long")
    return fill_down_within(c, "v", "r", ["conv_id"], [F.col("turn")], ("village", "reference")).select("conv_id", "turn", F.coalesce("village", none).alias("village"), F.coalesce("reference", none).alias("reference"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'CHINA') ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_chain_orders(spark, d):
    """Orders with their customer, its nation and that one's region, as users have memberships, scopes and units; one nation is unknown."""
    from .operators.listing import left_chain

    t = lambda name: S.table(spark, d, name)
    steps = [(t("customer").select("c_custkey", "c_name", "c_nationkey"), "o_custkey", "c_custkey"), (t("nation").filter("n_name <> 'CHINA'").select("n_nationkey", "n_name", "n_regionkey"), "c_nationkey", "n_nationkey"), (t("region").select("r_regionkey", "r_name"), "n_regionkey", "r_regionkey")]
    return left_chain(t("orders").select("o_orderkey", "o_custkey"), steps).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH p AS (SELECT user_id, list({'id': event_id, 'k': (props->>'$.k')::INT, 'kind': event_type} ORDER BY event_id) AS l FROM events GROUP BY 1)
SELECT user_id, i::INT AS ordinal, l[i].id AS event_id, l[i].k AS k, len(l)::INT AS n_events, '{"kind":"' || l[i].kind || '","user":' || user_id || '}' AS built FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM p)""")
def payload_members_events(spark, d):
    """Each user's events as one payload, opened again in order, with typed values from paths two levels down."""
    from .functions import payload as J

    e = S.table(spark, d, "events").select("user_id", "event_id", "event_type", J.parsed(F.col("props")).alias("props"))
    one = F.struct("event_id", F.struct(J.at(F.col("props"), "$.k", "int").alias("k")).alias("inner"), F.col("event_type").alias("kind"))
    text = e.groupBy("user_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("events"))).alias("text"))
    told = text.select("user_id", J.parsed(F.col("text")).alias("payload"))
    told = told.withColumn("n_events", J.length(F.col("payload"), "$.events"))
    each = J.opened(told, "payload", "$.events", "user_id", "n_events")
    kind = J.at(F.col("member"), "$.kind")
    return each.select("user_id", "ordinal", J.at(F.col("member"), "$.event_id", "bigint").alias("event_id"), J.at(F.col("member"), "$.inner.k", "int").alias("k"), "n_events", J.built(kind=kind, user=F.col("user_id")).alias("built"))


# Orders as approved plans, lines as rows of three cells: finished ones are tables without a header, open ones tables below their first row, pending ones
# forms of three cells. Lines with one number share cells, of which the largest value counts.
@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS r, MAX(l_partkey) AS part, MAX(l_quantity::INT) AS qty, MAX(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
p AS (SELECT c.*, o_orderstatus AS s, MAX(r) OVER (PARTITION BY k) AS last FROM c JOIN orders ON o_orderkey = k),
rows_ AS (SELECT k, r, part, qty, flag FROM p WHERE s = 'F' OR (s = 'O' AND r > 1)),
f AS (SELECT k, 1 AS r, MAX(part) FILTER (r = 1) AS part, MAX(qty) FILTER (r = 2) AS qty, MAX(flag) FILTER (r = 3) AS flag FROM p WHERE s = 'P' GROUP BY k),
a AS (SELECT * FROM rows_ UNION ALL SELECT * FROM f),
v AS (SELECT k, r, 'part' AS code, part::INT AS n, NULL AS t FROM a WHERE part IS NOT NULL UNION ALL SELECT k, r, 'qty', qty, NULL FROM a WHERE qty IS NOT NULL UNION ALL SELECT k, r, 'flag', NULL, flag FROM a WHERE flag IS NOT NULL)
SELECT k || ':s0:g:r' || r AS record_id, code, n AS integer_value, t AS text_value FROM v""")
def plan_facts_orders(spark, d):
    from .operators.layouts import materialize_plans

    lines = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").alias("row")).agg(F.max("l_partkey").alias("part"), F.max(F.col("l_quantity").cast("int")).alias("qty"), F.max("l_returnflag").alias("flag"))
    lines = written(lines)
    fields = [("part", "integer", 1), ("qty", "integer", 2), ("flag", "text", 3)]
    cell = F.array(*[F.struct(F.lit(c).alias("col"), F.col(name).cast("string").alias("value")) for name, _, c in fields])
    cells = lines.select("item_id", F.lit(0).alias("sheet"), "row", F.inline(cell))
    last = lines.groupBy("item_id").agg(F.max("row").alias("last"))
    o = S.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("plan_id"), "o_orderstatus").join(last, F.col("plan_id") == F.col("item_id"))
    o = written(o)
    table = F.col("o_orderstatus") == "O"
    none = F.lit(None).cast("string")
    at = [F.lit(0).alias("sheet"), F.lit("g").alias("region_id")]
    layout = F.when(F.col("o_orderstatus") == "F", "headerless_table").when(table, "explicit_header_table").otherwise("form")
    bottom = F.greatest("last", F.lit(3))
    regions = o.filter(~table | (F.col("last") > 1)).select(
        "plan_id", *at, F.lit(0).alias("ordinal"), layout.alias("layout"), F.lit("table").alias("region_kind"), F.lit(1).alias("top"), F.lit(1).alias("left"), bottom.alias("bottom"), F.lit(3).alias("right"),
        F.when(table, 2).otherwise(1).alias("data_top"), bottom.alias("data_bottom"), F.lit(1).alias("data_left"), F.lit(3).alias("data_right"), F.array().cast("array<int>").alias("excluded"), F.lit(True).alias("materialize"),
        F.lit("t@1").alias("template"), F.lit("line").alias("record_type"), F.array().cast("array<string>").alias("identity"),
    )
    mapping = F.inline(F.array(*[F.struct(F.lit(name).alias("code"), none.alias("role"), F.lit(kind).alias("data_type"), F.lit(False).alias("required"), F.lit(c).alias("map_col")) for name, kind, c in fields]))
    own = regions.select("plan_id", *at, "layout")
    form = F.col("layout") == "form"
    mappings = own.select("plan_id", "sheet", "region_id", "layout", mapping).withColumns({"selector": F.when(form, "cell").otherwise("physical_column"), "map_row": F.when(form, F.col("map_col"))}).drop("layout")
    headers = own.filter("layout = 'explicit_header_table'").select("plan_id", "sheet", "region_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("col"), F.array(F.lit("h")).alias("header_path"))
    facts, _ = materialize_plans(cells, o.select("plan_id", "item_id", none.alias("supersedes_plan_id")), regions, mappings, headers)
    return facts.values.select("record_id", "code", "integer_value", "text_value")


# What pending orders lead to: their customers, nations and regions, and their lines' parts and suppliers, whose nations lead on.
@query("""WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN o ON l_orderkey = o_orderkey),
c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN o ON o_custkey = c_custkey), n AS (SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM c UNION ALL SELECT s_nationkey FROM supplier JOIN l ON l_suppkey = s_suppkey))
SELECT kind, id::VARCHAR AS id, steps FROM (
  SELECT 'order' AS kind, o_orderkey AS id, 0 AS steps FROM o UNION ALL SELECT DISTINCT 'customer', o_custkey, 1 FROM o UNION ALL SELECT DISTINCT 'part', l_partkey, 1 FROM l UNION ALL SELECT DISTINCT 'supplier', l_suppkey, 1 FROM l
  UNION ALL SELECT 'nation', k, 2 FROM n UNION ALL SELECT DISTINCT 'region', n_regionkey, 3 FROM nation JOIN n ON k = n_nationkey)""")
def reached_from_orders(spark, d):
    from .operators.transfer import reached

    t = lambda name: S.table(spark, d, name)
    edge = lambda df, kind, key, to_kind, to: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(to_kind).alias("to_kind"), F.col(to).cast("string").alias("to_id"))
    references = edge(t("orders"), "order", "o_orderkey", "customer", "o_custkey").unionByName(edge(t("lineitem"), "order", "l_orderkey", "part", "l_partkey")).unionByName(edge(t("lineitem"), "order", "l_orderkey", "supplier", "l_suppkey"))
    references = references.unionByName(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey")).unionByName(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey"))
    roots = t("orders").filter("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"))
    return reached(roots, references)
