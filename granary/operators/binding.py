"""Published field bindings to the columns of a file's regions, by what tells a column best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import paths_equivalent, spaced

NUMBERED = r":column:(\d+)$"  # fixed value: how a source id ends that holds its physical column


def leaf(path: Column) -> Column:
    """The last part of a path that isn't blank; null if all are."""
    return F.try_element_at(F.filter(F.transform(path, spaced), lambda p: p != ""), F.lit(-1))


def bind_columns(bindings: DataFrame, columns: DataFrame, projected: DataFrame | None = None) -> DataFrame:
    """One row per binding: region_id, ordinal, place, matched_by; both null if no column is its.

    bindings: region_id, ordinal (from 0), source_column_id, header_path. columns: region_id, place (from 0), col, source_column_id, header_path.
    projected: region_id, position, source_column_id, offset, what an approved layout says. In order: the only column with the
    binding's source id (source_id); where a layout knows that id the column at its offset, if their paths are equivalent, and else none (offset); the only
    column of an equivalent path (path); the only one at the number that ends the id, of an equivalent path or the same last part (physical_column); with as many
    bindings as columns the one of the same number, of an equivalent path (ordinal). Equivalent paths share their last part, so bindings
    and columns meet by that.
    """
    key = ["region_id", "ordinal"]
    own = bindings.select(*key, "source_column_id", "header_path", leaf(F.col("header_path")).alias("leaf"))
    there = columns.select("region_id", "place", "col", F.col("source_column_id").alias("column_id"), F.col("header_path").alias("column_path"), leaf(F.col("header_path")).alias("leaf"))
    met = own.join(there, ["region_id", "leaf"]).withColumn("alike", paths_equivalent(F.col("header_path"), F.col("column_path")))

    def only(df: DataFrame, name: str) -> DataFrame:
        found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias(name))
        return found.filter("n = 1").select(*key, name)

    by_id = only(own.join(there.withColumnRenamed("column_id", "source_column_id").drop("leaf"), ["region_id", "source_column_id"]), "by_id")
    by_path = only(met.filter("alike"), "by_path")
    number = F.nullif(F.regexp_extract("source_column_id", NUMBERED, 1), F.lit("")).try_cast("int")
    by_number = only(met.filter(F.col("col") == number), "by_number")
    same_size = own.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).join(there.groupBy("region_id").agg(F.count(F.lit(1)).alias("n")), ["region_id", "n"]).select("region_id")
    by_turn = met.filter("alike and place = ordinal").join(same_size, "region_id", "left_semi").select(*key, F.col("place").alias("by_turn"))
    full = own.select(*key, "source_column_id").join(by_id, key, "left").join(by_path, key, "left").join(by_number, key, "left").join(by_turn, key, "left")
    if projected is None:
        full = full.withColumns({"known": F.lit(False), "by_offset": F.lit(None).cast("long")})
    else:
        first = Window.partitionBy("region_id", "source_column_id").orderBy("position")
        said = projected.withColumn("turn", F.row_number().over(first)).filter("turn = 1").select("region_id", "source_column_id", "offset")
        known = own.join(said, ["region_id", "source_column_id"]).select(*key, "offset")
        at = met.filter("alike").select(*key, "place").join(known, key).filter("place = offset").select(*key, F.col("place").alias("by_offset"))
        full = full.join(known.select(*key, F.lit(True).alias("known")), key, "left").join(at, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    ways = [(F.col("by_id"), "source_id"), (F.col("by_offset"), "offset"), *[(F.when(~F.col("known"), F.col(c)), name) for c, name in (("by_path", "path"), ("by_number", "physical_column"), ("by_turn", "ordinal"))]]
    how = F.coalesce(*[F.when(place.isNotNull(), name) for place, name in ways])
    return full.select(*key, F.coalesce(*[place for place, _ in ways]).alias("place"), how.alias("matched_by"))
