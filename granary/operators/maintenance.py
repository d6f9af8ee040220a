"""Keeping the store: bundles, snapshots, deletions with counts, corpus inventories, masking."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored table after a merge by key, and the counts by action: inserted, updated, unchanged, removed or kept.

    complete: incoming holds all there is, so rows without one are removed. Both sides have
    the same columns, keys are not null and unique.
    """
    rest = [c for c in stored.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*[F.col(c) for c in rest], F.lit(1).alias("_there")).alias(name))
    both = pack(stored, "old").join(pack(incoming.select(stored.columns), "new"), list(keys), "full")
    action = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "removed" if complete else "kept").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    both = both.withColumn("action", action)
    now = both.filter("action <> 'removed'").select(*keys, F.coalesce("new", "old").alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(stored.columns)
    return now, both.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def row_checksum(df: DataFrame) -> DataFrame:
    """n and a checksum of a table's rows that no order of rows changes."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum"))


def export_bundle(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as compressed JSON lines, and a manifest of counts and checksums."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        line = row_checksum(df).select(F.lit(name).alias("name"), F.lit(df.schema.json()).alias("schema"), "n", "checksum")
        manifest = line if manifest is None else manifest.unionByName(line)
    if manifest is not None:
        manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest.bundle")


def import_bundle(spark, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError if one isn't what its manifest says."""
    from pyspark.sql.types import StructType

    out = {}
    for line in spark.read.json(f"{folder}/_manifest.bundle", schema="name string, schema string, n long, checksum string").collect():  # a row per table
        df = spark.read.schema(StructType.fromJson(json.loads(line["schema"]))).json(f"{folder}/{line['name']}")
        got = row_checksum(df).first()
        if (got["n"], got["checksum"]) != (line["n"], line["checksum"]):
            raise ValueError(f"{line['name']} differs from its manifest")
        out[line["name"]] = df
    return out


def restore_published(items: DataFrame, snapshot: DataFrame, key: str = "code", version: str = "published_version") -> DataFrame:
    """items with the published versions of a snapshot; what the snapshot doesn't know is unpublished."""
    told = snapshot.select(key, F.col(version).alias("_told"))
    return items.join(told, key, "left").withColumn(version, F.col("_told")).drop("_told")


def latest_versions(versions: DataFrame, key: str = "code", version: str = "version") -> DataFrame:
    """Of each key the row of the highest version."""
    rest = [c for c in versions.columns if c not in (key, version)]
    top = versions.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in rest], F.lit(1).alias("_x")), version).alias("row"), F.max(version).alias(version))
    return top.select(*[F.col(c) if c in (key, version) else F.col("row")[c].alias(c) for c in versions.columns])


def deletion(tables: Mapping[str, DataFrame], keys: Mapping[str, str], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table without the ids in gone (id), and before and deleted counts per table."""
    left, counts = {}, None
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    for name, df in tables.items():
        marked = df.join(ids, df[keys[name]] == ids["_gone"], "left")
        left[name] = marked.filter("_gone is null").drop("_gone")
        line = marked.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("before"), F.count("_gone").alias("deleted"))
        counts = line if counts is None else counts.unionByName(line)
    return left, counts


def last_lines(lines: DataFrame, key: str = "sha", value: str = "value") -> DataFrame:
    """JSON lines (value, line number) of a checkpoint: of each key the last line; lines that aren't JSON objects are skipped."""
    parsed = lines.select("line", value, F.get_json_object(value, f"$.{key}").alias(key)).filter(f"{key} is not null")
    return parsed.groupBy(key).agg(F.max_by(value, "line").alias(value))


def plan_difference(present: DataFrame, wanted: DataFrame, key: str, version: str) -> DataFrame:
    """What to do to get from present to wanted: key and action (add, reimport, restore, none)."""
    a, b = present.select(key, F.col(version).alias("have")), wanted.select(key, F.col(version).alias("want"))
    both = a.join(b, key, "full")
    action = F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "restore").when(F.col("have") != F.col("want"), "reimport").otherwise("none")
    return both.select(key, action.alias("action"))


def corpus_inventory(files: DataFrame) -> DataFrame:
    """files: path, length, content (binaryFile). One row per content: sha, paths, n, bytes; the first path stands for all."""
    hashed = files.select(F.sha2("content", 256).alias("sha"), "path", "length")
    return hashed.groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n"), F.max("length").alias("bytes"))


def corpus_baseline(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Per workbook: sheets, cells, formulas, errors and regions."""
    c = cells.groupBy("workbook_id").agg(F.countDistinct("sheet").alias("sheets"), F.count("value").alias("cells"), F.count("formula").alias("formulas"), F.max("error").alias("error"))
    return c.join(regions.groupBy("workbook_id").agg(F.count(F.lit(1)).alias("regions")), "workbook_id", "left").na.fill(0, ["regions"])


def text_evidence(c: Column) -> Column:
    """A digest and a length instead of a text that may be private."""
    return F.struct(F.sha2(c, 256).alias("sha256"), F.length(c).alias("length"))


def synthetic(value: Column, kind: Column, case: Column, row: Column, col: Column) -> Column:
    """A stand-in of the same kind for a cell's value (text and kind): blanks and formulas stay.

    Dates move by case days; numbers and names are made from case, row and column.
    """
    number = (case * 100_000 + row * 100 + col).cast("string")
    compact = F.regexp_replace(value, r"(?U)\s+", "")
    text = (
        F.when(F.replace(compact, F.lit(","), F.lit("")).rlike(r"^[-+]?\d+(?:\.\d+)?$"), number)
        .when(compact.rlike(r"^\d{4}[-/.年]\d{1,2}(?:[-/.月]\d{1,2}日?)?$"), F.concat(F.lit("2099-01-"), F.lpad((row % 28 + 1).cast("string"), 2, "0")))
        .when(col == 1, F.concat(F.lit("测试同名人员-"), row % 5))
        .otherwise(F.concat_ws("-", F.concat(F.lit("样例"), case), row, col))
    )
    moved = F.when(kind == "date", F.date_add(value.try_cast("date"), case).cast("string")).when(kind == "datetime", (value.try_cast("timestamp") + F.make_dt_interval(case)).cast("string"))
    return (
        F.when(value.isNull() | (value == "") | value.startswith("="), value)
        .when(kind == "boolean", ((case + row + col) % 2 == 0).cast("string"))
        .when(moved.isNotNull(), moved)
        .when(kind == "integer", number)
        .when(kind == "decimal", F.round(case * 1000 + row + col / 100, 2).cast("string"))
        .otherwise(text)
    )


def batch_status(items: DataFrame, batches: DataFrame) -> DataFrame:
    """items: batch_id, status; batches: batch_id, total. Counts per batch and its status.

    Finished files are imported, partial, pending a rebuild, failed or deleted ones.
    """
    n = lambda label, *states: F.count(F.when(F.col("status").isin(*states), 1)).alias(label)
    counted = items.groupBy("batch_id").agg(n("completed", "imported"), n("partial", "partial", "pending_rebuild"), n("active", "needs_review", "materializing"), n("failed", "failed"), n("deleted", "deleted"))
    full = batches.select("batch_id", "total").join(counted, "batch_id", "left").na.fill(0, ["completed", "partial", "active", "failed", "deleted"])
    done = F.col("completed") + F.col("partial") + F.col("failed") + F.col("deleted")
    status = F.when(done == 0, F.when(F.col("active") > 0, "running").otherwise("pending")).when(done < F.col("total"), "running").when(F.col("failed") == F.col("total"), "failed")
    return full.withColumn("status", status.when(F.col("failed") + F.col("partial") > 0, "partial").otherwise("completed"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def record_tree(records: DataFrame, groups: Sequence[str], row: str = "source_row", at: str = "created_at") -> DataFrame:
    """Roll-up of records: per group their number, passed and failed ones, first and last row, and the latest time."""
    return records.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quality_status") == "passed", 1)).alias("passed"), F.count(F.when(F.col("quality_status") == "failed", 1)).alias("failed"),
        F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.max(at).alias("latest"),
    )


def last_turns(turns: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The last n rows of each group, in order."""
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
