"""The store of facts: wide records in Parquet, by tenant, record type and approved plan.

A plan's records are a partition of their own, so writing a plan again replaces what it wrote
before and nothing else, and a scope's tenant, type and plan prune the scan.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.contracts import FactSet
from .work import work_dir

PARTS = ["tenant_id", "record_type", "approved_plan_id"]


def write(records: DataFrame, path: str) -> None:
    """Write records by partition; the partitions of the plans among them are replaced whole.

    Every record needs its plan. Rows that repeat a record_id are an error of the caller's.
    """
    spread = records.repartition(*PARTS, F.pmod(F.xxhash64("record_id"), F.lit(64)))  # no plan is one task's
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def read(spark: SparkSession, path: str, like: FactSet) -> FactSet:
    """The fact set as it is stored: like's contract over the store's records, which are told apart by their place in it."""
    stored = spark.read.schema(like.df.schema).parquet(path)
    return replace(like, df=stored.select(*[F.col(f"`{c}`") for c in like.df.columns]), stored=True)


def without_items(path: str, spark: SparkSession, items: DataFrame) -> None:
    """Rewrite the partitions that hold records of the items (item_id) without them."""
    stored = spark.read.parquet(path)
    aside = work_dir(spark)  # a table can't be read and replaced in one job
    stored.join(items, "item_id", "left_semi").select(*PARTS).distinct().write.parquet(f"{aside}/touched")
    touched = spark.read.parquet(f"{aside}/touched")
    stored.join(touched, PARTS, "left_semi").join(items, "item_id", "left_anti").write.partitionBy(*PARTS).parquet(f"{aside}/kept")
    back = spark.read.schema(stored.schema).parquet(f"{aside}/kept")
    back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)
    emptied = touched.join(back.select(*PARTS).distinct(), PARTS, "left_anti")
    for r in emptied.collect():  # a row a plan that lost all its records
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        where = spark._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{c}={escaped(r[c])}" for c in PARTS))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
