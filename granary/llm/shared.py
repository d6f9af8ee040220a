"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
BATCH = 4 << 20  #: bytes of an Arrow batch, at most, unless one row has more


def small_batches(spark: SparkSession) -> None:
    """Let the session send Python no Arrow batches of more than BATCH bytes.

    Spark's own bound is 64 MB, of which JVM and Python hold several at once for each task. A
    smaller bound that the session already has stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH:
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where a local session names none (tests on one machine), a temporary folder is set for the
    session; on a cluster executors couldn't see that, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())  # each thread has its own


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that saved() writes inside go at the end, but for those it keeps."""
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            _remove(path)


def free_name(name: str, *frames: DataFrame) -> str:
    """name with as many underscores after it as it takes to be no column's name, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    if _scopes.get() and not keep:
        _scopes.get()[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(path: str) -> None:
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
