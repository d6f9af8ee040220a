"""Facts in versions: what a plan wrote becomes visible at once, and readers keep the version they began with.

    data/<write>/<table>/             what one commit brought: records, values, lineage, issues
    manifests/<version>-<write>/      plan_id, write: for each plan the write that holds it
    manifests/<version>.version       the version is there; names its manifest

A commit writes its tables aside, then the manifest of the next version, then moves a file to that version's name, which
only one writer can. A writer that is killed before leaves files that no version names. Nothing is ever
changed in place; unused() removes what no kept version names.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.materialize import Facts
from .work import remove

TABLES = ("records", "values", "lineage", "issues")
MANIFEST = "plan_id string, write string"
MARK = ".version"


class Conflict(RuntimeError):
    """Other writers have taken the next version as often as a commit tries."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are there, ascending: one small number each."""
    where, fs = _path(spark, f"{root}/manifests")
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(n.removesuffix(MARK)) for n in names if n.endswith(MARK) and not n.startswith((".", "_")))


def _folder(spark: SparkSession, root: str, version: int) -> str:
    """The folder of a version's manifest."""
    return f"{root}/manifests/" + spark.read.text(f"{root}/manifests/{version}{MARK}").first()["value"]


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(_folder(spark, root, version)) if version else spark.createDataFrame([], MANIFEST)


def _claim(spark: SparkSession, root: str, version: int, folder: str) -> bool:
    """Give the manifest's folder the version; False if another has it. The file is whole before it has its name."""
    aside, fs = _path(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(folder.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    keep = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(keep, 1)
    options[0] = keep.NONE
    to, _ = _path(spark, f"{root}/manifests/{version}{MARK}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(aside), fs.makeQualified(to), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(aside, False)
        return False
    return True


def commit(spark: SparkSession, root: str, facts: Facts | None, plans: DataFrame, attempts: int = 10) -> int:
    """Make facts the only ones of plans (plan_id), in one step; returns the version. All tables of facts have plan_id.

    Plans without facts, and all of them if facts is None, are left empty: so a plan that another supersedes goes when it
    is listed beside that one. Facts of plans that are not listed are an error of the caller's. If another writer
    was faster, the manifest is made again from what that one left; the facts are not.
    """
    write = uuid.uuid4().hex
    plans = plans.select(F.col("plan_id").cast("string")).distinct()
    if facts is not None:
        for name in TABLES:
            getattr(facts, name).write.parquet(f"{root}/data/{write}/{name}")
        held = spark.read.parquet(f"{root}/data/{write}/records").select(F.col("plan_id").cast("string")).distinct().withColumn("write", F.lit(write))
    else:
        held = spark.createDataFrame([], MANIFEST)
    for _ in range(attempts):
        before = max(versions(spark, root), default=0)
        folder = f"{before + 1}-{write}"
        manifest(spark, root, before).join(plans, "plan_id", "left_anti").unionByName(held).write.mode("overwrite").parquet(f"{root}/manifests/{folder}")
        if _claim(spark, root, before + 1, folder):
            return before + 1
        remove(spark, f"{root}/manifests/{folder}")
    raise Conflict(f"version {before + 1} was taken {attempts} times")


def read(spark: SparkSession, root: str, version: int | None = None) -> Facts:
    """The facts of a version, the newest if none is named; later commits don't change what it returns.

    Only the folders of writes that the version names are read, as many as commits that still hold a plan.
    """
    there = versions(spark, root)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no version {version if there else ''} in {root}")
    told = manifest(spark, root, version or there[-1])
    writes = [r["write"] for r in told.select("write").distinct().collect()]
    if not writes:
        raise FileNotFoundError(f"version {version or there[-1]} of {root} holds no plan")

    def table(name: str) -> DataFrame:
        paths = [f"{root}/data/{w}/{name}" for w in writes]
        rows = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("write", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1))
        return rows.join(told, ["plan_id", "write"], "left_semi").drop("write")

    return Facts(*[table(name) for name in TABLES])


def unused(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove versions but the last keep, and writes that none of those names; returns the writes. Not while a commit runs, whose write no version names yet."""
    there = versions(spark, root)
    for old in there[:-keep]:
        folder = _folder(spark, root, old)
        remove(spark, f"{root}/manifests/{old}{MARK}")
        remove(spark, folder)
    named = {r["write"] for v in there[-keep:] for r in manifest(spark, root, v).select("write").distinct().collect()}
    where, fs = _path(spark, f"{root}/data")
    gone = [n for n in (x.getPath().getName() for x in fs.listStatus(where)) if n not in named] if fs.exists(where) else []
    for name in gone:
        remove(spark, f"{root}/data/{name}")
    return gone
