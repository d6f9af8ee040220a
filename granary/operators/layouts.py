"""Approved plans of any layout to facts: tables, forms and tables without a header, many plans at once.

A form is one record, whose fields stand at cells; a table's rows are its records, with or without a header.
Everything hangs on the plan: a record's id is made of its plan, region and row, so a plan that runs
again makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import label_key
from ..functions.values import SPARK_TYPES, column_letters, normalize, spreadsheet_error, unfilled
from ..sources.work import written
from .materialize import SEQUENCE, Facts

FORM, HEADERLESS = "form", "headerless_table"
ROWS = ("table", "matrix")  # fixed values: the layouts; explicit_header_table is table
REGION = ["plan_id", "sheet", "region_id"]
IN_RANGE = "row >= data_top and row <= data_bottom and col >= data_left and col <= data_right"


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) != "", F.lit(False))


def laid_out(regions: DataFrame) -> DataFrame:
    """regions with layout filled in: that of the decision, else form for a region of that kind, else table."""
    named = F.when(F.col("layout") == "explicit_header_table", "table").otherwise(F.nullif(F.col("layout"), F.lit("")))
    return regions.withColumn("layout", F.coalesce(named, F.when(F.col("region_kind") == FORM, FORM).otherwise("table")))


def with_fields(regions: DataFrame, mappings: DataFrame, headers: DataFrame) -> DataFrame:
    """regions with their fields (structs of the mappings' columns) and the columns that have a header, named; fields of no region stand in a row without known."""
    fields = mappings.groupBy(*REGION).agg(F.collect_list(F.struct("code", "role", "data_type", "required", "selector", "map_row", F.col("map_col").alias("col"))).alias("fields"))
    named = headers.filter(F.size("header_path") > 0).groupBy(*REGION).agg(F.collect_set("col").alias("named"))
    return regions.withColumn("known", F.lit(True)).join(named, REGION, "left").join(fields, REGION, "full")


def plan_problems(plans: DataFrame, held: DataFrame) -> DataFrame:
    """plan_id, problem: the first thing that keeps a plan from being materialized, of those that have one.

    held: regions of the plans, see with_fields, laid out. Regions that are not to be materialized are held to nothing.
    """
    beyond = "data_top < top or data_bottom > bottom or data_bottom < data_top or data_left < left or data_right > right or data_right < data_left"
    form, headerless, rows = F.col("layout") == FORM, F.col("layout") == HEADERLESS, F.col("layout").isin(*ROWS)
    said = lambda at, problem: F.struct(F.lit(at).alias("at"), F.lit(problem).alias("problem"))
    # The range must be there, whole, and hold the rows that are left out.
    outside = F.coalesce(F.expr(f"({beyond}) or exists(excluded, r -> r < data_top or r > data_bottom)"), F.lit(True))
    of_region = F.when(outside, said(2, "data_range_outside_region")).when(~(form | headerless | rows), said(3, "unknown_layout"))

    def of_field(f: Column) -> Column:
        off = (f["map_row"] < F.col("data_top")) | (f["map_row"] > F.col("data_bottom")) | (f["col"] < F.col("data_left")) | (f["col"] > F.col("data_right"))
        return (
            F.when(form & ~F.coalesce(f["selector"] == "cell", F.lit(False)), said(4, "form_field_without_cell"))
            .when(headerless & ~F.coalesce(f["selector"] == "physical_column", F.lit(False)), said(5, "headerless_field_without_column"))
            .when(rows & (F.coalesce(f["selector"], F.lit("physical_column")) != "physical_column"), said(6, "table_field_without_column"))
            .when((f["col"] < F.col("left")) | (f["col"] > F.col("right")), said(7, "column_outside_region"))
            .when(form & (off | F.array_contains("excluded", f["map_row"])), said(8, "form_cell_outside_range"))
        )

    of_fields = F.coalesce(F.transform("fields", of_field), F.array().cast("array<struct<at:int,problem:string>>"))
    first = F.when(F.col("known").isNull(), said(1, "mapping_without_region")).when(F.col("materialize"), F.array_min(F.concat(F.array(of_region), of_fields)))
    empty = plans.select("plan_id").join(held.filter("known").select("plan_id"), "plan_id", "left_anti").select("plan_id", said(0, "no_regions").alias("p"))
    every = held.select("plan_id", first.alias("p")).filter("p is not null").unionByName(empty)
    return every.groupBy("plan_id").agg(F.min("p").alias("p")).select("plan_id", "p.problem")


def materialize_plans(cells: DataFrame, plans: DataFrame, regions: DataFrame, mappings: DataFrame, headers: DataFrame, done: DataFrame | None = None) -> tuple[Facts, DataFrame]:
    """Facts of all plans that can be materialized, and a row per plan.

    cells: item_id, sheet, row, col, value. plans: plan_id, item_id, supersedes_plan_id.
    regions: plan_id, sheet, region_id, ordinal, layout, region_kind, top, left, bottom, right, data_top,
    data_bottom, data_left, data_right, excluded (rows), materialize, template, record_type, identity (codes).
    mappings: plan_id, sheet, region_id, code, role, data_type, required, selector (cell, physical_column or null),
    map_row, map_col. headers: plan_id, sheet, region_id, col, header_path, of tables. done: plan_id of plans that
    have run and make nothing again.

    A record without a required field, without part of its identity, with a value not of its type, or whose identity a
    record of its plan, template and type has had before, is failed and stays. A spreadsheet error is a field without
    value. A table's rows are left out by the rules of excluded_rows, over the columns that have a header. A field that
    is there twice in a record with one role fails its plan whole. The second table has plan_id, status (completed, partial,
    failed, skipped), problem, record_count, value_count, supersedes_plan_id; nulls in excluded, role and identity are none.
    """
    plans = plans.select("plan_id", "item_id", "supersedes_plan_id")
    skipped = plans.select("plan_id").limit(0) if done is None else done.select("plan_id").distinct()
    fresh = plans.join(skipped, "plan_id", "left_anti")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    regions = laid_out(regions).withColumns({"excluded": F.coalesce("excluded", none("int")), "identity": F.coalesce("identity", none("string"))})
    mappings = mappings.withColumn("role", F.coalesce("role", F.lit("")))
    # Cells meet their regions once, each of which carries its fields; what makes a record is told by one more shuffle, and written.
    laid = written(with_fields(regions, mappings, headers).join(fresh.select("plan_id", "item_id"), "plan_id"))
    problems = plan_problems(fresh, laid)
    active = laid.filter("known and materialize").join(problems, "plan_id", "left_anti")
    box = active.select(*REGION, "item_id", "layout", "data_top", "data_bottom", "data_left", "data_right", "excluded", "fields", "named")
    there = cells.filter(filled(F.col("value"))).select("item_id", "sheet", "row", "col", "value")
    near = there.join(box, ["item_id", "sheet"]).filter("row >= data_top and row <= data_bottom").filter(~F.array_contains("excluded", F.col("row")))
    form, in_rows = F.col("layout") == FORM, F.col("layout").isin(*ROWS)
    own = F.filter(F.coalesce("fields", F.array().cast(box.schema["fields"].dataType)), lambda f: f["col"] == F.col("col"))
    near = near.withColumn("own", own).withColumn("hit", F.filter("own", lambda f: ~form | (f["map_row"] == F.col("row"))))
    near = near.select(
        *REGION, F.when(form, F.col("data_top")).otherwise(F.col("row")).alias("source_row"), "item_id", "row", "col", "value",
        # What makes a record: a form's cells, a headerless table's fields, the cells below a header.
        F.coalesce((form & F.expr(IN_RANGE)) | ((F.col("layout") == HEADERLESS) & (F.size("hit") > 0)), F.lit(False)).alias("makes"),
        (in_rows & F.coalesce(F.array_contains("named", F.col("col")), F.lit(False))).alias("below"), F.exists("own", lambda f: f["code"].eqNullSafe(F.lit(SEQUENCE))).alias("numbers"),
        ((F.size("own") > 0) | ~F.col("col").between(F.col("data_left"), F.col("data_right"))).alias("covers"), "hit",
    ).filter("makes or below or size(hit) > 0")
    record = [*REGION, "source_row"]
    field = lambda c: F.col(f"f.{c}").alias(c)
    hit = near.withColumn("f", F.explode_outer("hit")).select(*record, "item_id", "row", "col", "value", "makes", "below", "numbers", "covers", F.col("f").isNotNull().alias("hit"), *map(field, ("code", "role", "data_type")))
    hit = hit.repartition("plan_id", "source_row")
    hit = hit.withColumn("unavailable", spreadsheet_error(F.col("value")))
    # Within a lambda, so that the six kinds don't become one generated method too large to be compiled.
    of_kind = lambda v, kind: F.when((F.col("data_type") == kind) & ~F.col("unavailable"), normalize(v, kind)["value"]).cast(SPARK_TYPES[kind])
    typed = F.transform(F.array("value"), lambda v: F.struct(*[of_kind(v, kind).alias(f"{kind}_value") for kind in SPARK_TYPES]))[0]
    hit = hit.withColumn("typed", typed).select("*", "typed.*").drop("typed")
    found = F.greatest(*[F.col(f"{k}_value").isNotNull() for k in SPARK_TYPES])
    hit = hit.withColumn("failed", ~F.col("unavailable") & ~found).withColumn("coordinate", F.concat(column_letters(F.col("col")), "row"))
    # One sort serves both windows.
    hit = hit.withColumn("n", F.count(F.when(F.col("hit") & ~F.col("failed"), 1)).over(Window.partitionBy(*record, "code", "role")))
    of_record = Window.partitionBy(*record)
    over = lambda f, c: f(F.when(F.col("below"), c)).over(of_record)
    odd = over(F.bool_or, F.col("numbers") & F.exists(F.array("value"), lambda v: normalize(v, "integer")["failed"]))
    of_rows = over(F.bool_or, F.lit(True)) & ~(odd | over(F.bool_and, F.col("numbers")) | over(F.bool_and, F.exists(F.array("value"), unfilled)))
    hit = hit.withColumns({"there": F.bool_or("makes").over(of_record) | F.coalesce(of_rows, F.lit(False)), "covered": F.coalesce(over(F.bool_and, F.col("covers")), F.lit(True))})
    record_id = F.concat_ws(":", "plan_id", F.concat(F.lit("s"), "sheet"), "region_id", F.concat(F.lit("r"), "source_row"))
    told = written(hit.filter("there").drop("makes", "below", "numbers", "covers", "there")).withColumn("record_id", record_id)
    twice = told.filter("n > 1").select("plan_id").distinct()
    problems = problems.unionByName(twice.withColumn("problem", F.lit("field_twice_with_one_role")))
    told = told.join(twice, "plan_id", "left_anti")
    hits = told.filter("hit")
    records = told.select(*record, "record_id", "covered").distinct().join(active.select(*REGION, "item_id", "ordinal", "layout", "template", "record_type", "identity"), REGION)
    wanted = mappings.select(*REGION, "code", "required")

    needs = wanted.filter("required").groupBy(*REGION).agg(F.collect_set("code").alias("needs"))
    held = hits.groupBy("record_id").agg(
        F.collect_set("code").alias("codes"), F.collect_set(F.when(F.col("failed"), F.struct("coordinate", "code"))).alias("bad"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("role") == "", F.struct("code", F.trim("value").alias("v")))))).alias("held"),
    )
    full = records.join(needs, REGION, "left").join(held, "record_id", "left")
    full = full.withColumn("missing", F.array_sort(F.array_except(F.coalesce("needs", none("string")), F.coalesce("codes", none("string")))))
    full = full.withColumn("key", F.transform("identity", lambda c: F.coalesce(F.try_element_at("held", c), F.lit(""))))
    keyed, whole = F.size("identity") > 0, F.forall("key", lambda v: v != "")
    full = full.withColumn("complete", keyed & whole)
    # Only records with a whole identity are held against each other.
    first = Window.partitionBy("plan_id", "template", "record_type", "key").orderBy("ordinal", "source_row", "record_id")
    again = full.filter("complete").withColumn("again", F.row_number().over(first) > 1).filter("again").select("record_id", "again")
    full = full.join(again, "record_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    issue = lambda code, detail: F.struct(F.lit(code).alias("code"), detail.alias("detail"))
    no_issue = F.array().cast("array<struct<code:string,detail:string>>")
    issues = F.concat(
        F.transform(F.coalesce("bad", F.array().cast("array<struct<coordinate:string,code:string>>")), lambda b: issue("normalization_failed", F.concat(b["code"], F.lit("@"), b["coordinate"]))),
        F.transform("missing", lambda c: issue("required_missing", c)),
        F.when(keyed & ~whole, F.array(issue("incomplete_identity", F.array_join("identity", ",")))).otherwise(no_issue),
        F.when(F.col("again"), F.array(issue("duplicate_identity", F.array_join("key", ",")))).otherwise(no_issue),
    )
    full = full.withColumn("issues", issues)
    by_rows = F.col("layout").isin(*ROWS)
    partial = (by_rows & ~F.col("covered")) | (~by_rows & (F.size("missing") > 0)) | (F.size(F.coalesce("bad", F.array().cast("array<struct<coordinate:string,code:string>>"))) > 0)
    full = full.withColumn("mapping_status", F.when(partial, "partial").otherwise("complete"))
    shown = full.select("record_id", "plan_id", "item_id", "sheet", "region_id", "template", "record_type", "source_row", "mapping_status", F.when(F.size("issues") > 0, "failed").otherwise("passed").alias("quality_status"))
    good = hits.filter("not failed")
    values = good.select("record_id", "plan_id", "code", "role", "data_type", *[f"{k}_value" for k in SPARK_TYPES], "unavailable")
    normalizer = F.when(F.col("unavailable"), "source-spreadsheet-error/v1").otherwise(F.concat("data_type", F.lit("/v1")))
    lineage = good.select("record_id", "plan_id", "code", "role", "item_id", "sheet", "coordinate", F.col("value").alias("raw_value"), normalizer.alias("normalizer"))
    facts = Facts(shown, values, lineage, full.select("record_id", "plan_id", F.explode("issues").alias("issue")).select("record_id", "plan_id", "issue.code", "issue.detail"))
    counted = full.groupBy("plan_id").agg(F.count(F.lit(1)).alias("records"), F.count(F.when((F.size("issues") > 0) | (F.col("mapping_status") == "partial"), 1)).alias("flawed"))
    n_values = values.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_values"))
    state = plans.join(counted, "plan_id", "left").join(n_values, "plan_id", "left").join(problems.groupBy("plan_id").agg(F.min("problem").alias("problem")), "plan_id", "left").join(skipped.withColumn("ran", F.lit(True)), "plan_id", "left")
    status = F.when(F.col("ran").isNotNull(), "skipped").when(F.col("problem").isNotNull(), "failed").when(F.col("flawed") > 0, "partial").otherwise("completed")
    zero = F.lit(0).cast("long")
    return facts, state.select("plan_id", status.alias("status"), "problem", F.coalesce("records", zero).alias("record_count"), F.coalesce("n_values", zero).alias("value_count"), "supersedes_plan_id")


def form_selectors(cells: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Where a form's fields stand: region_id, code, label_row, label_col, map_row, map_col.

    cells: sheet_id, row, col, value; regions: sheet_id, region_id, top, left, bottom, right; labels: code, label.
    A label's field is the first cell right of it that is no label; if the next cell there is one, or the region ends, the first
    below it by the same rule. A field's place may be empty: then it is the next one. Labels with neither have no row.
    """
    key = ["sheet_id", "region_id"]
    inside = F.expr("row >= top and row <= bottom and col >= left and col <= right")
    own = cells.filter(filled(F.col("value"))).join(regions, "sheet_id").filter(inside).withColumn("label", label_key(F.col("value")))
    known = labels.select("code", label_key(F.col("label")).alias("label")).filter("label <> ''").dropDuplicates(["label", "code"])
    marked = own.join(known, "label", "left").withColumn("is_label", F.col("code").isNotNull())

    def ahead(line: str, along: str):
        w = Window.partitionBy(*key, line).orderBy(along)
        # Rows of one cell, a label of several fields, are peers: the range begins behind all of them.
        w = w.rangeBetween(1, Window.unboundedFollowing)
        return F.min(F.when(F.col("is_label"), F.col(along))).over(w), F.min(F.when(~F.col("is_label"), F.col(along))).over(w)

    (label_right, free_right), (label_below, free_below) = ahead("row", "col"), ahead("col", "row")
    seen = marked.withColumns({"label_right": label_right, "free_right": free_right, "label_below": label_below, "free_below": free_below}).filter("is_label")

    def place(here: str, end: str, next_label: str, free: str) -> Column:
        stop = F.coalesce(F.col(next_label), F.col(end) + 1)  # the first place that can't be the field's
        return F.when(stop > F.col(here) + 1, F.when(F.col(free) < stop, F.col(free)).otherwise(F.col(here) + 1))

    right, below = place("col", "right", "label_right", "free_right"), place("row", "bottom", "label_below", "free_below")
    found = seen.select(*key, "code", F.col("row").alias("label_row"), F.col("col").alias("label_col"), F.when(right.isNotNull(), F.col("row")).otherwise(below).alias("map_row"), F.coalesce(right, F.when(below.isNotNull(), F.col("col"))).alias("map_col"))
    return found.filter("map_row is not null")
