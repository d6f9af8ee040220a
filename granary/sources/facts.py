"""Fact sets from tables: a generic wide adapter, and the one for the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import SPARK_TYPES
from ..plans.contracts import FactSet, Measure, Scope, name

TENANT = "t1"


def table(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{what}.parquet")


def decimal(c: Column) -> Column:
    """A double as DECIMAL(38,10) by way of its shortest text."""
    return c.cast("string").cast("decimal(38,10)")


def wide(df: DataFrame, code: str, key: Column, fields: dict[str, tuple[str, Column]], unit: Column, item: Column, created: Column, quality: Column | None = None, absent: dict[str, Column] | None = None, row: Column | None = None, roles: dict[tuple[str, str], Column] | None = None, **contract) -> FactSet:
    """fields: last part of the code to (type, value). absent: where a field isn't there at all.

    row: the source row. roles: (last part, role) to the field's value in that role, absent where null.
    """
    absent, roles = absent or {}, roles or {}
    columns = [
        F.struct((~absent[k] if k in absent else F.lit(True)).alias("present"), (F.when(~absent[k], c) if k in absent else c).cast(SPARK_TYPES[kind]).alias("v")).alias(name(f"{code}.{k}"))
        for k, (kind, c) in fields.items()
    ]
    record = df.select(
        F.concat(F.lit(f"{code}:"), key.cast("string")).alias("record_id"),
        F.lit(TENANT).alias("tenant_id"),
        unit.cast("string").alias("unit_id"),
        item.alias("item_id"),
        F.lit(code).alias("record_type"),
        F.lit(f"approved_plan:{code}").alias("provenance"),
        created.cast("timestamp").alias("created_at"),
        (F.lit("passed") if quality is None else quality).alias("quality_status"),
        F.lit(None).cast("string").alias("region_template_id"),
        F.lit(None).cast("int").alias("region_template_version"),
        F.lit(f"template:{code}").alias("template_id"),
        F.lit(1).alias("template_version"),
        F.lit(f"plan:{code}").alias("approved_plan_id"),
        F.lit("sheet1").alias("sheet_id"),
        F.lit("region1").alias("region_id"),
        (F.lit(None) if row is None else row).cast("int").alias("source_row"),
        *columns,
        *[F.struct(c.isNotNull().alias("present"), c.cast(SPARK_TYPES[fields[k][0]]).alias("v")).alias(name(f"{code}.{k}", role)) for (k, role), c in roles.items()],
    )
    named = {f"{code}.{k}": tuple(r for (x, r) in roles if x == k) for k, _ in roles}
    return FactSet(code, record, {f"{code}.{k}": kind for k, (kind, _) in fields.items()}, roles=named, **contract)


def file_of(code: str, key: Column, files: int = 4) -> Column:
    return F.concat(F.lit(f"{code}#"), F.pmod(key, F.lit(files)).cast("string"))


def orders(spark: SparkSession, sf_dir: str) -> FactSet:
    """Orders by the nation of their customer; field closed is absent for open orders, and shown without value for pending ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("unit"))
    df = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    fields = {
        "key": ("integer", F.col("o_orderkey")),
        "status": ("text", F.col("o_orderstatus")),
        "priority": ("text", F.col("o_orderpriority")),
        "totalprice": ("decimal", decimal(F.col("o_totalprice"))),
        "date": ("datetime", F.col("o_orderdate")),
        "day": ("date", F.to_date("o_orderdate")),
        "customer": ("integer", F.col("o_custkey")),
        "large": ("boolean", F.col("o_totalprice") > 200000),
        "closed": ("text", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))),
    }
    return wide(
        df, "orders", F.col("o_orderkey"), fields, F.coalesce("unit", F.lit(0)), file_of("orders", F.col("o_orderkey")), F.col("o_orderdate"),
        F.when(F.col("o_orderkey") % 97 == 0, "failed").otherwise("passed"), {"closed": F.col("o_orderstatus") == "O"},
        identity=("orders.key",), dimensions=("orders.status", "orders.priority", "orders.day", "orders.totalprice", "orders.large", "orders.closed", "orders.customer", "orders.date"),
        measures={"orders.totalprice": Measure(("sum", "avg", "min", "max")), "orders.key": Measure(("count",), False, True), "orders.customer": Measure(("count",), False)}, blocked=("orders.customer",),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> FactSet:
    fields = {
        "order": ("integer", F.col("l_orderkey")),
        "part": ("integer", F.col("l_partkey")),
        "quantity": ("decimal", decimal(F.col("l_quantity"))),
        "price": ("decimal", decimal(F.col("l_extendedprice"))),
        "flag": ("text", F.col("l_returnflag")),
        "status": ("text", F.col("l_linestatus")),
        "ship": ("datetime", F.col("l_shipdate")),
    }
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return wide(
        table(spark, sf_dir, "lineitem"), "lineitem", key, fields, F.lit(0), file_of("lineitem", F.col("l_orderkey")), F.col("l_shipdate"),
        identity=("lineitem.order",), dimensions=("lineitem.flag", "lineitem.status", "lineitem.quantity"), measures={f"lineitem.{m}": Measure(("sum", "avg", "min", "max")) for m in ("quantity", "price")},
    )


def customer(spark: SparkSession, sf_dir: str) -> FactSet:
    """Customers as persons of households: a nation is a household, and the customer of its smallest key the head."""
    df = table(spark, sf_dir, "customer")
    heads = df.groupBy(F.col("c_nationkey").alias("h_nation")).agg(F.min("c_custkey").alias("head"))
    df = df.join(heads, F.col("c_nationkey") == F.col("h_nation"))
    fields = {
        "key": ("integer", F.col("c_custkey")),
        "person": ("text", F.col("c_name")),
        "household": ("text", F.format_string("H%03d", F.col("c_nationkey"))),
        "relation": ("text", F.when(F.col("c_custkey") == F.col("head"), "户主").otherwise("成员")),
        "segment": ("text", F.col("c_mktsegment")),
        "balance": ("decimal", decimal(F.col("c_acctbal"))),
    }
    return wide(
        df, "customer", F.col("c_custkey"), fields, F.col("c_nationkey"), file_of("customer", F.col("c_custkey")), F.lit("2024-01-01"),
        identity=("customer.key",), dimensions=("customer.segment", "customer.household", "customer.person", "customer.balance"), measures={"customer.balance": Measure(("sum", "avg", "min", "max"))},
    )


def part(spark: SparkSession, sf_dir: str) -> FactSet:
    fields = {"key": ("integer", F.col("p_partkey")), "name": ("text", F.col("p_name")), "brand": ("text", F.col("p_brand")), "size": ("integer", F.col("p_size")), "price": ("decimal", decimal(F.col("p_retailprice")))}
    return wide(
        table(spark, sf_dir, "part"), "part", F.col("p_partkey"), fields, F.lit(0), file_of("part", F.col("p_partkey")), F.lit("2024-01-01"), row=F.col("p_partkey"),
        units=spark.createDataFrame([("0", "everywhere")], "unit_id string, name string"),
        identity=("part.key",), dimensions=("part.brand", "part.size", "part.name"), measures={"part.size": Measure(("sum", "avg", "min", "max"))},
    )


def events(spark: SparkSession, sf_dir: str) -> FactSet:
    fields = {"user": ("integer", F.col("user_id")), "type": ("text", F.col("event_type")), "value": ("decimal", decimal(F.col("value"))), "at": ("datetime", F.col("ts"))}
    return wide(
        table(spark, sf_dir, "events"), "events", F.col("event_id"), fields, F.lit(0), file_of("events", F.col("event_id")), F.col("ts"),
        identity=("events.user",), dimensions=("events.type",), measures={"events.value": Measure(("sum", "avg", "min", "max"))},
    )


ALL = Scope(TENANT, tuple(str(i) for i in range(25)))
