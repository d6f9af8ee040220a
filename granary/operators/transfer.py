"""Transfer of what records refer to: what is reached, each content once under its digest, and checks on arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

NODE = ["kind", "id"]
KINDS = 1000  #: up to so many kinds are named to the scan of a round


def reached(roots: DataFrame, references: DataFrame) -> DataFrame:
    """kind, id, steps: what roots (kind, id) lead to over references (kind, id, to_kind, to_id), themselves at 0 steps.

    A round goes one step on from what the last one found, each round is written, and what is known isn't followed again, so
    circles end. A round reads only references of the kinds that it goes on from, and of equal ones each: what they lead to is
    made distinct, which is less. Null kinds and ids lead nowhere.
    """
    edges = references.dropna(subset=[*NODE, "to_kind", "to_id"]).select(*NODE, "to_kind", "to_id")
    front = written(roots.select(*NODE).dropna().distinct())
    found, steps = front.withColumn("steps", F.lit(0)), 0
    while kinds := [x.kind for x in front.select("kind").distinct().limit(KINDS + 1).collect()]:
        steps += 1
        own = edges.filter(F.col("kind").isin(kinds)) if len(kinds) <= KINDS else edges
        onward = own.join(front, NODE, "left_semi").select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        front = written(onward.join(found, NODE, "left_anti"))
        found = found.unionByName(front.withColumn("steps", F.lit(steps)))
    return found


def dangling(found: DataFrame, known: DataFrame) -> DataFrame:
    """kind, id of what is reached and not known (kind, id)."""
    return found.select(*NODE).distinct().join(known.select(*NODE).distinct(), NODE, "left_anti")


def pack_files(files: DataFrame, wanted: DataFrame, folder: str) -> None:
    """Write the wanted files (id, expected_sha256 or null) of files (id, path, content): each content once, and an index of ids.

    A wanted file that isn't there stands in the index without a digest.
    """
    own = files.select("id", "path", "content").join(wanted.select("id").distinct(), "id", "left_semi").withColumn("sha256", F.sha2("content", 256))
    once = own.withColumn("turn", F.row_number().over(Window.partitionBy("sha256").orderBy("id", "path"))).filter("turn = 1")
    once.select("sha256", "content", F.octet_length("content").cast("long").alias("size"), F.substring("sha256", 1, 2).alias("part")).write.partitionBy("part").parquet(f"{folder}/contents")
    index = wanted.select("id", "expected_sha256").distinct().join(own.select("id", "path", "sha256"), "id", "left")
    index.write.parquet(f"{folder}/index")


def arrived(spark, folder: str) -> DataFrame:
    """id, path, sha256, problem of a bundle's files: missing (there was no such file), lost (its content didn't arrive), damaged (the content isn't that of its digest), unexpected (the digest isn't the one expected), or null."""
    index = spark.read.schema("id string, expected_sha256 string, path string, sha256 string").parquet(f"{folder}/index")
    held = spark.read.schema("sha256 string, content binary, size long, part string").parquet(f"{folder}/contents")
    told = held.select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("whole"))
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("whole").isNull(), "lost").when(~F.col("whole"), "damaged").when(F.col("expected_sha256") != F.col("sha256"), "unexpected")
    return index.join(told, "sha256", "left").select("id", "path", "sha256", problem.alias("problem"))


def unpacked(spark, folder: str) -> DataFrame:
    """id, path, content of the files that arrived without a problem."""
    good = arrived(spark, folder).filter("problem is null").select("id", "path", "sha256")
    return good.join(spark.read.schema("sha256 string, content binary, size long, part string").parquet(f"{folder}/contents"), "sha256").select("id", "path", "content")
