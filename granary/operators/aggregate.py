"""Aggregations over wide fact sets. The three counts differ, as their names say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.contracts import CoverageError, FactSet, QueryError
from ..sources.work import written


def count_identities(df: DataFrame, facts: FactSet, identity: Sequence[str], with_nulls: bool) -> DataFrame:
    """Distinct identity tuples. with_nulls: a field that is there without a value makes a tuple; else it needs a value."""
    keep = facts.present if with_nulls else lambda c: facts.value(c).isNotNull()
    for c in identity:
        df = df.filter(keep(c))
    return df.select(*[facts.value(c).alias(f"k{i}") for i, c in enumerate(identity)]).distinct().agg(F.count(F.lit(1)).alias("value"))


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("record_id").alias("value"))


def evidence_columns() -> list[Column]:
    return [F.countDistinct("record_id").alias("record_count"), F.countDistinct("item_id").alias("source_file_count"), F.countDistinct("unit_id").alias("unit_count")]


def evidence(df: DataFrame, units: bool = True, stored: bool = False) -> DataFrame:
    """Records, source items and units behind an answer, each counted once.

    stored: df is filtered from a store, which has a row for each record. Then a record is told by its file and row there, and
    what goes between tasks is a bitmap for each some ten thousand rows of a file; their counts add up. Records of other tables are told apart
    by their ids.
    """
    files = [F.countDistinct("item_id").alias("source_file_count"), *([F.countDistinct("unit_id").alias("unit_count")] if units else [])]
    if not stored:
        return df.agg(F.countDistinct("record_id").alias("record_count"), *files)
    row = F.col("_metadata.row_index")
    placed = df.select("item_id", "unit_id", F.col("_metadata.file_path").alias("file"), F.bitmap_bucket_number(row).alias("bucket"), F.bitmap_bit_position(row).alias("bit"))
    bits = placed.groupBy("item_id", "unit_id", "file", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    counted = bits.groupBy("item_id", "unit_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), *files)


def aggregate(how: str, c: Column, distinct: bool = True) -> Column:
    if how == "count":
        return F.countDistinct(c) if distinct else F.count(c)
    found = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}.get(how)
    if found is None:
        raise QueryError(f"unknown aggregation: {how}")
    return found(c)


def group_counts(df: DataFrame, facts: FactSet, code: str, requested: Sequence | None = None) -> DataFrame:
    """Records for each value of a field, checked for coverage; requested values are zero-filled, in order.

    Fails if records have no value, or if a value that wasn't requested occurs. The groups are counted once, written, and
    checked from there.
    """
    counted = written(df.groupBy(facts.value(code).alias("value")).agg(F.countDistinct("record_id").alias("record_count")))
    wanted = None if not requested else [str(v) for v in requested]
    known = F.col("value").isNotNull() & (F.lit(True) if wanted is None else F.col("value").cast("string").isin(wanted))
    check = counted.agg(F.coalesce(F.sum(F.when(~known, F.col("record_count"))), F.lit(0)).alias("outside")).first()
    if check["outside"]:
        raise CoverageError(f"groups leave out {check['outside']} records")
    if wanted is None:
        return counted.orderBy(F.col("value").cast("string"))
    spark = df.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "place int, asked string")
    return asked.join(counted, F.col("asked") == F.col("value").cast("string"), "left").orderBy("place").select(F.col("asked").alias("value"), F.coalesce("record_count", F.lit(0)).alias("record_count"))
