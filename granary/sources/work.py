"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder where driver and executors can both write; only a local session may do without spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
    return f"{found.rstrip('/')}/facts-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written and read back, so what comes after it neither repeats its work nor hangs on its lineage."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    _PATHS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Remove what written() has written in this process; results that read it must be stored by then."""
    while _PATHS:
        remove(spark, _PATHS.pop())
