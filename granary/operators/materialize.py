"""Cells to typed, quality-checked facts with lineage, as joins, groupings and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import SPARK_TYPES, column_letters, normalize, spreadsheet_error, unfilled
from ..plans.contracts import FactSet, name

SEQUENCE = "base.sequence_number"  # fixed value: the field that numbers rows


@dataclass(frozen=True)
class Facts:
    """records: one row per source row; values: one per field; lineage: one per value; issues."""

    records: DataFrame
    values: DataFrame
    lineage: DataFrame
    issues: DataFrame


def materialize(cells: DataFrame, mappings: DataFrame, first_row: int, last_row: int | None = None) -> Facts:
    """cells: item_id, sheet, row, col, value; mappings: sheet, col, code, data_type, required, identity.

    A value that isn't of its type is left out and fails its record; a spreadsheet error is a
    field without value. A record fails, too, without a required field, with part of its
    identity, or if an earlier row has its identity. Failed records stay, and queries skip them.
    Rows without any mapped cell make no record, nor do those that excluded_rows names. Null and
    blank cells are empty.
    """
    inside = (F.col("row") >= first_row) & (F.lit(True) if last_row is None else F.col("row") <= last_row)
    plan = mappings.select("sheet", "col", "code", "data_type", "required", "identity")
    there = cells.filter(inside & F.col("value").isNotNull() & (F.trim("value") != ""))
    there = there.join(excluded_rows(there, plan), ["item_id", "sheet", "row"], "left_anti")
    mapped = there.join(plan, ["sheet", "col"]).select("item_id", "sheet", "row", "col", "value", "code", "data_type")
    error = spreadsheet_error(F.col("value"))
    for kind, spark_type in SPARK_TYPES.items():
        got = normalize(F.col("value"), kind)
        mine = F.col("data_type") == kind
        mapped = mapped.withColumn(f"{kind}_value", F.when(mine & ~error, got["value"]).cast(spark_type))
    found = F.greatest(*[F.col(f"{k}_value").isNotNull() for k in SPARK_TYPES])
    mapped = mapped.withColumn("unavailable", error).withColumn("failed", ~error & ~found)
    record_id = F.concat_ws(":", "item_id", F.concat(F.lit("s"), "sheet"), F.concat(F.lit("r"), "row"))
    mapped = mapped.withColumn("record_id", record_id).withColumn("coordinate", F.concat(column_letters(F.col("col")), "row"))

    wanted = plan.groupBy("sheet").agg(F.collect_set(F.when(F.col("required"), F.col("code"))).alias("needs"), F.sort_array(F.collect_set(F.when(F.col("identity"), F.col("code")))).alias("keys"))
    text = F.coalesce(*[F.col(f"{k}_value").cast("string") for k in SPARK_TYPES])
    rows = mapped.groupBy("item_id", "sheet", "row", "record_id").agg(
        F.collect_set(F.when(~F.col("failed"), F.col("code"))).alias("codes"),
        F.collect_set(F.when(F.col("failed"), F.struct("coordinate", "code"))).alias("bad"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("failed"), F.struct("code", text.alias("v")))))).alias("held"),
    )
    rows = rows.join(wanted, "sheet", "left").withColumn("identity", F.transform("keys", lambda k: F.col("held")[k])).withColumn("missing", F.array_except("needs", "codes"))
    full = (F.size("keys") > 0) & F.forall("identity", lambda v: v.isNotNull())
    partly = F.exists("identity", lambda v: v.isNotNull()) & ~full & (F.size("keys") > 0)
    # Only rows with a whole identity are held against each other; the others have nothing in common.
    first = Window.partitionBy("item_id", "sheet", "identity").orderBy("row")
    again = rows.filter(full).withColumn("again", F.row_number().over(first) > 1).filter("again").select("record_id", "again")
    rows = rows.join(again, "record_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    issues = F.concat(
        F.transform("bad", lambda b: F.struct(F.lit("normalization_failed").alias("code"), F.concat(b["code"], F.lit("@"), b["coordinate"]).alias("detail"))),
        F.transform("missing", lambda c: F.struct(F.lit("required_missing").alias("code"), c.alias("detail"))),
        F.when(partly, F.array(F.struct(F.lit("incomplete_identity").alias("code"), F.array_join("keys", ",").alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>")),
        F.when(F.col("again"), F.array(F.struct(F.lit("duplicate_identity").alias("code"), F.array_join("identity", ",").alias("detail")))).otherwise(F.array().cast("array<struct<code:string,detail:string>>")),
    )
    rows = rows.withColumn("issues", issues)
    records = rows.select("record_id", "item_id", "sheet", F.col("row").alias("source_row"), F.when(F.size("issues") > 0, "failed").otherwise("passed").alias("quality_status"))
    kept = mapped.filter("not failed")
    values = kept.select("record_id", "code", "data_type", *[f"{k}_value" for k in SPARK_TYPES], "unavailable")
    lineage = kept.select("record_id", "code", "item_id", "sheet", "coordinate", F.col("value").alias("raw_value"), F.concat("data_type", F.lit("/v1")).alias("normalizer"))
    return Facts(records, values, lineage, rows.select("record_id", F.explode("issues").alias("issue")).select("record_id", "issue.code", "issue.detail"))


def excluded_rows(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """item_id, sheet, row of rows that are no records.

    Their number isn't an integer (sums, notes, repeated headers), nothing but their number is
    filled in, or all their cells are a form's own texts.
    """
    filled = cells.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    numbered = filled.join(mappings.filter(F.col("code") == SEQUENCE).select("sheet", "col", F.lit(True).alias("numbers")), ["sheet", "col"], "left")
    row = numbered.groupBy("item_id", "sheet", "row").agg(
        F.coalesce(F.bool_or(F.col("numbers") & normalize(F.col("value"), "integer")["failed"]), F.lit(False)).alias("odd"),
        F.coalesce(F.bool_and(F.coalesce("numbers", F.lit(False))), F.lit(False)).alias("bare"),
        F.bool_and(unfilled(F.col("value"))).alias("form"),
    )
    return row.filter("odd or bare or form").select("item_id", "sheet", "row")


def raw_rows(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """item_id, sheet, row, columns: every cell of a row, mapped or not, by its column's letters: header_path, value, coordinate.

    headers: sheet, col, header_path; a column without one has an empty path.
    """
    named = cells.filter("value is not null").join(headers.select("sheet", "col", "header_path"), ["sheet", "col"], "left")
    letters = column_letters(F.col("col"))
    cell = F.struct(F.coalesce("header_path", F.array().cast("array<string>")).alias("header_path"), F.col("value"), F.concat(letters, "row").alias("coordinate"))
    return named.groupBy("item_id", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(letters.alias("key"), cell.alias("value"))))).alias("columns"))


def fact_set(facts: Facts, code: str, types: dict[str, str], items: DataFrame, **contract) -> FactSet:
    """The wide fact set of what was materialized, with its lineage.

    items: item_id, tenant_id, unit_id, created_at, template_id, template_version, approved_plan_id,
    file_name, relative_path, source_sha256. A field that a record lacks is absent; one whose cell
    holds a spreadsheet error is there without value.
    """
    cells = facts.values.select("record_id", F.col("code").alias("field"), F.struct(F.lit(True).alias("present"), *[f"{k}_value" for k in SPARK_TYPES]).alias("cell"))
    fields = [F.first(F.when(F.col("field") == c, F.col("cell")), ignorenulls=True).alias(f"c{i}") for i, c in enumerate(types)]
    by_record = cells.groupBy("record_id").agg(*fields)
    columns = [F.struct(F.coalesce(F.col(f"c{i}.present"), F.lit(False)).alias("present"), F.col(f"c{i}.{kind}_value").alias("v")).alias(name(c)) for i, (c, kind) in enumerate(types.items())]
    records = facts.records.join(items, "item_id").join(by_record, "record_id", "left").select(
        "record_id", "tenant_id", "unit_id", "item_id", F.lit(code).alias("record_type"), F.concat(F.lit("approved_plan:"), "approved_plan_id").alias("provenance"), "created_at", "quality_status",
        F.lit(None).cast("string").alias("region_template_id"), F.lit(None).cast("int").alias("region_template_version"), "template_id", "template_version", "approved_plan_id",
        F.concat(F.lit("s"), "sheet").alias("sheet_id"), F.lit("region1").alias("region_id"), "source_row", *columns,
    )
    told = facts.lineage.join(items.select("item_id", "source_sha256"), "item_id")
    lineage = told.select("record_id", F.col("code").alias("field_code"), "source_sha256", F.concat(F.lit("s"), "sheet").alias("sheet_id"), F.concat(F.lit("s"), "sheet", F.lit(":"), "coordinate").alias("source_cell_id"), "coordinate", F.col("raw_value").alias("display_value"), "normalizer")
    return FactSet(code, records, types, lineage=lineage, sources=items.select("item_id", "file_name", "relative_path", "source_sha256"), **contract)


def audit_evidence(facts: Facts, raw: DataFrame) -> DataFrame:
    """Violations of the evidence in a stored set of tables, counted by code; all codes, zero or not.

    raw: item_id, sheet, row, columns, see raw_rows. A lineage must name its record's item and row,
    a raw cell that is there, and that cell's value; the typed value must be what the raw
    value normalizes to.
    """
    source = facts.records.select("record_id", F.col("item_id").alias("own_item"), F.col("sheet").alias("own_sheet"), F.col("source_row").alias("own_row"))
    cells = raw.select("item_id", "sheet", "row", F.explode(F.map_values("columns")).alias("c")).select("item_id", "sheet", F.col("c.coordinate").alias("coordinate"), F.col("c.value").alias("cell_value"), F.lit(True).alias("there"))
    told = facts.lineage.join(source, "record_id").join(cells, ["item_id", "sheet", "coordinate"], "left")
    held = facts.values.join(told, ["record_id", "code"])
    typed = F.lit(False)
    for kind in SPARK_TYPES:
        fresh = normalize(F.col("raw_value"), kind)["value"]
        typed |= (F.col("data_type") == kind) & ~F.when(spreadsheet_error(F.col("raw_value")), F.lit(None)).otherwise(fresh).eqNullSafe(F.col(f"{kind}_value"))
    n = lambda when, label: F.count(F.when(when, 1)).alias(label)
    row = F.regexp_extract("coordinate", r"(\d+)$", 1).try_cast("int")
    of_lineage = told.agg(
        n(F.col("item_id") != F.col("own_item"), "lineage_of_other_item"), n((row != F.col("own_row")) | (F.col("sheet") != F.col("own_sheet")), "lineage_of_other_row"),
        n(F.col("there").isNull(), "raw_cell_missing"), n(F.col("there").isNotNull() & ~F.col("cell_value").eqNullSafe(F.col("raw_value")), "raw_value_differs"),
    )
    of_values = held.agg(n(typed, "value_not_of_raw"))
    codes = ["lineage_of_other_item", "lineage_of_other_row", "raw_cell_missing", "raw_value_differs"]
    each = lambda df, names: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("violation"), F.col(c).alias("n")) for c in names])))
    return audit(facts).unionByName(each(of_lineage, codes)).unionByName(each(of_values, ["value_not_of_raw"]))


def audit(facts: Facts) -> DataFrame:
    """Violations of the store, counted by code: values without record or lineage, lineage without value, duplicates."""
    key = ["record_id", "code"]
    v, l = facts.values.select(*key), facts.lineage.select(*key)
    count = lambda df, code: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("violation"), "n")
    checks = [
        count(v.join(facts.records.select("record_id"), "record_id", "left_anti"), "value_without_record"),
        count(v.join(l, key, "left_anti"), "value_without_lineage"),
        count(l.join(v, key, "left_anti"), "lineage_without_value"),
        count(v.groupBy(*key).count().filter("count > 1"), "duplicate_value"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def without_items(facts: Facts, items: DataFrame) -> Facts:
    """The store without what came from the items: item_id."""
    gone = facts.records.join(items, "item_id", "left_semi").select("record_id")
    drop = lambda df: df.join(gone, "record_id", "left_anti")
    return Facts(drop(facts.records), drop(facts.values), drop(facts.lineage), drop(facts.issues))
