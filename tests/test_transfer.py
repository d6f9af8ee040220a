"""What is reached, and bundles of files that arrive whole or don't."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from granary.operators.transfer import arrived, dangling, pack_files, reached, unpacked


def test_reached_matches_a_plain_walk(spark):
    r = random.Random(3)
    nodes = [(k, str(i)) for k in "ab" for i in range(40)]
    edges = [(*r.choice(nodes), *r.choice(nodes)) for _ in range(70)] + [("a", "0", "a", "0"), ("a", "1", "b", None), (None, "1", "b", "2")]
    roots = [("a", "0"), ("b", "7"), ("a", "0")]
    steps, front = {n: 0 for n in roots}, set(roots)
    while front:
        front = {(e[2], e[3]) for e in edges if (e[0], e[1]) in front and None not in e} - set(steps)
        steps |= {n: max(steps.values()) + 1 for n in front}
    found = reached(spark.createDataFrame(roots, "kind string, id string"), spark.createDataFrame(edges, "kind string, id string, to_kind string, to_id string"))
    assert {(x.kind, x.id): x.steps for x in found.collect()} == steps and found.count() == len(steps)
    known = spark.createDataFrame([n for n in steps if n != ("b", "7")], "kind string, id string")
    assert [tuple(x) for x in dangling(found, known).collect()] == [("b", "7")]


def test_bundles_round_trip_and_tell_what_is_wrong(spark, tmp_path):
    files = [("1", "a.xlsx", b"one"), ("2", "copy of a.xlsx", b"one"), ("3", "b.csv", b"two"), ("4", "c.csv", b"three"), ("5", "unused", b"five")]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, p, c in files], "id string, path string, content binary")
    sha = {i: s for i, s in df.select("id", F.sha2("content", 256)).collect()}
    wanted = spark.createDataFrame([("1", sha["1"]), ("2", None), ("3", sha["3"]), ("4", "0" * 64), ("9", None)], "id string, expected_sha256 string")
    folder = str(tmp_path / "bundle")
    pack_files(df, wanted, folder)
    assert spark.read.parquet(f"{folder}/contents").count() == 3
    assert {x.id: x.problem for x in arrived(spark, folder).collect()} == {"1": None, "2": None, "3": None, "4": "unexpected", "9": "missing"}
    assert {(x.id, x.path, bytes(x.content)) for x in unpacked(spark, folder).collect()} == {f for f in files if f[0] in "123"}
    # One content is lost on the way, another changed.
    for sign, damage in ((sha["1"], False), (sha["3"], True)):
        for path in (tmp_path / "bundle" / "contents" / f"part={sign[:2]}").iterdir():
            if path.suffix == ".parquet":
                t = pq.read_table(path, partitioning=None)
                keep = t.filter(pa.compute.not_equal(t["sha256"], sign))
                changed = pa.table({"sha256": [sign], "content": [b"else"], "size": pa.array([4], pa.int64())}, schema=t.schema)
                pq.write_table(pa.concat_tables([keep, changed]) if damage and sign in t["sha256"].to_pylist() else keep, path)
            if path.suffix == ".crc":
                path.unlink()
    spark.catalog.refreshByPath(folder)
    assert {x.id: x.problem for x in arrived(spark, folder).collect()} == {"1": "lost", "2": "lost", "3": "damaged", "4": "unexpected", "9": "missing"}


def test_a_round_reads_only_references_that_it_goes_on_from(spark, monkeypatch):
    from granary.operators import transfer as T

    plans, real = [], T.written
    monkeypatch.setattr(T, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    edge = lambda n, kind, to: spark.range(n).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(to).alias("to_kind"), (F.col("id") + 1).cast("string").alias("to_id"))
    edges = edge(5, "a", "b").unionByName(edge(7, "b", "c")).unionByName(edge(9, "x", "y"))
    want = {("a", "2", 0), ("b", "3", 1), ("c", "4", 2)}
    roots = spark.createDataFrame([("a", "2")], "kind string, id string")
    assert {tuple(x) for x in reached(roots, edges).collect()} == want
    assert "Range (0, 5" in plans[1] and "Range (0, 7" not in plans[1] and "Range (0, 9" not in "".join(plans)
    monkeypatch.setattr(T, "KINDS", 0)
    assert {tuple(x) for x in reached(roots, edges).collect()} == want
