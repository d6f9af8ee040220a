"""Streaming ingestion: new spreadsheet files of a folder become rows of cells, once each.

A content is known by its owner and its digest. What batch brought it first is on record in the target itself, so the
same content in a later batch, under another name or after a restart adds nothing, and a batch that
runs again sees what it saw before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sheets import read_cells

FILES = "path string, modificationTime timestamp, length long, content binary"


def once_each(spark: SparkSession, files: DataFrame, number: int, ledger: str) -> DataFrame:
    """Of files (path, content and the owner's columns) those whose content no earlier batch has had, and of equal ones the first path.

    ledger: a table of sha and the owner's columns by batch, to which this batch's new ones are written. Owners may be null.
    """
    owner = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    keyed = files.withColumn("sha", F.sha2("content", 256))
    first = keyed.groupBy(*owner, "sha").agg(F.min("path").alias("path"))
    kind = ", ".join([*(f"{c} {files.schema[c].dataType.simpleString()}" for c in owner), "sha string", "path string"])
    batches = _batches(spark, ledger, number)
    if batches:
        known = spark.read.schema(kind).parquet(*batches).select(*[F.col(c).alias(f"k_{c}") for c in (*owner, "sha")])
        same = F.lit(True)
        for c in (*owner, "sha"):
            same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
        first = first.join(known, same, "left_anti")
    first.write.mode("overwrite").parquet(f"{ledger}/batch={number}")
    new = spark.read.schema(kind).parquet(f"{ledger}/batch={number}").select(*[F.col(c).alias(f"k_{c}") for c in (*owner, "sha", "path")])
    same = F.col("path") == F.col("k_path")
    for c in (*owner, "sha"):
        same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return keyed.join(new, same, "left_semi").drop("sha")


def _batches(spark: SparkSession, ledger: str, before: int) -> list[str]:
    """The ledger's folders of batches before this one; a batch that runs again must not meet itself or what came later."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return [f"{ledger}/{n}" for n in names if n.startswith("batch=") and int(n.removeprefix("batch=")) < before]


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*", files_per_batch: int = 100, owner: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Read what is new in folder, append its cells to target, and stop.

    The checkpoint remembers the files that have been read. A batch that runs again after a
    failure writes to its own folder anew, so no cell is stored twice. A content is stored once for each owner: owner adds
    columns to the files, as their tenant and unit by path; without it there is one. The contents that are
    known stand in target/_contents, which readers of target pass over.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def store(batch: DataFrame, number: int) -> None:
        owned = owner(batch) if owner else batch
        new = once_each(spark, owned, number, f"{target}/_contents")
        columns = [c for c in owned.columns if c not in batch.columns]
        cells = read_cells(new)
        if columns:
            cells = cells.join(new.select("path", *columns), "path")
        cells.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
