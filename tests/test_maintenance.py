"""Merges, bundles, snapshots, deletions, inventories and masking."""

import pytest
from pyspark.sql import functions as F

from granary.operators import maintenance as M


def test_sync(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, "z", 3)], "k int, t string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 5), (4, "w", 4)], "k int, t string, n int")
    now, counts = M.sync(a, b, ["k"])
    assert sorted((r.k, r.t, r.n or 0) for r in now.collect()) == [(1, "x", 0), (2, "y", 5), (3, "z", 3), (4, "w", 4)]
    assert {r.action: r.n for r in counts.collect()} == {"unchanged": 1, "updated": 1, "kept": 1, "inserted": 1}
    now, counts = M.sync(a, b, ["k"], complete=True)
    assert sorted(r.k for r in now.collect()) == [1, 2, 4] and {r.action: r.n for r in counts.collect()}["removed"] == 1


def test_bundle(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", None), (2, None, 2.5)], "k int, t string, n double")
    M.export_bundle({"a": a, "b": a.limit(0)}, f"{tmp_path}/v1")
    back = M.import_bundle(spark, f"{tmp_path}/v1")
    assert sorted(map(str, back["a"].collect())) == sorted(map(str, a.collect())) and back["b"].count() == 0
    spark.createDataFrame([(9, "extra", 1.0)], a.schema).write.mode("append").json(f"{tmp_path}/v1/a")
    with pytest.raises(ValueError, match="differs"):
        M.import_bundle(spark, f"{tmp_path}/v1")


def test_versions_and_plans(spark):
    v = spark.createDataFrame([("a", 1, "old"), ("a", 3, None), ("b", 2, "x")], "code string, version int, note string")
    assert sorted(map(tuple, M.latest_versions(v).collect()), key=str) == [("a", 3, None), ("b", 2, "x")]
    items, snap = spark.createDataFrame([("a", 5), ("b", 1)], "code string, published_version int"), spark.createDataFrame([("a", 2)], "code string, published_version int")
    assert sorted(map(tuple, M.restore_published(items, snap).collect()), key=str) == [("a", 2), ("b", None)]
    p, w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int"), spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "k string, v int")
    assert dict(map(tuple, M.plan_difference(p, w, "k", "v").collect())) == {"a": "restore", "b": "none", "c": "reimport", "d": "add"}


def test_deletion(spark):
    t = spark.createDataFrame([("i1", 1), ("i2", 2), (None, 3)], "item_id string, n int")
    left, counts = M.deletion({"t": t, "e": t.limit(0)}, {"t": "item_id", "e": "item_id"}, spark.createDataFrame([("i1",), ("i1",), ("zz",)], "id string"))
    assert sorted(r.n for r in left["t"].collect()) == [2, 3] and {r.table: (r.before, r.deleted) for r in counts.collect()} == {"t": (3, 1), "e": (0, 0)}


def test_checkpoint_lines(spark):
    lines = spark.createDataFrame([(1, '{"sha":"a","v":1}'), (2, "broken{"), (3, '{"sha":"a","v":2}'), (4, '{"x":1}'), (5, '{"sha":"b"}')], "line int, value string")
    assert dict(map(tuple, M.last_lines(lines).collect())) == {"a": '{"sha":"a","v":2}', "b": '{"sha":"b"}'}


def test_inventory(spark):
    files = spark.createDataFrame([("/b", 2, bytearray(b"xx")), ("/a", 2, bytearray(b"xx")), ("/c", 0, bytearray(b""))], "path string, length long, content binary")
    assert sorted((r.paths, r.n, r.bytes) for r in M.corpus_inventory(files).collect()) == [(["/a", "/b"], 2, 2), (["/c"], 1, 0)]


def test_masking(spark):
    rows = [(None, "text"), ("", "text"), ("=A1", "text"), ("true", "boolean"), ("2024-02-28", "date"), ("17", "integer"), ("1.5", "decimal"), ("1,234.5", "text"), ("2024年5月6日", "text"), ("张三", "text")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, k string")
    got = [r.m for r in df.select("i", M.synthetic(F.col("v"), F.col("k"), F.lit(2), F.lit(3), F.lit(1)).alias("m")).orderBy("i").collect()]
    assert got == [None, "", "=A1", "true", "2024-03-01", "200301", "2003.01", "200301", "2099-01-04", "测试同名人员-3"]
    assert df.select(M.synthetic(F.lit("李四"), F.lit("text"), F.lit(2), F.lit(3), F.lit(4))).first()[0] == "样例2-3-4"
    assert tuple(df.select(M.text_evidence(F.lit("ab"))).first()[0])[1] == 2


def test_batches_trees_and_turns(spark):
    items = spark.createDataFrame([("a", "imported"), ("a", "failed"), ("b", "failed"), ("c", "needs_review"), ("d", "imported"), ("e", "imported")], "batch_id string, status string")
    totals = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 2), ("f", 1)], "batch_id string, total int")
    assert {r.batch_id: r.status for r in M.batch_status(items, totals).collect()} == {"a": "partial", "b": "failed", "c": "running", "d": "completed", "e": "running", "f": "pending"}
    rec = spark.createDataFrame([("g", 3, "passed", 1), ("g", 9, "failed", 5)], "g string, source_row int, quality_status string, created_at int")
    assert tuple(M.record_tree(rec, ["g"]).first()) == ("g", 2, 1, 1, 3, 9, 5)
    assert sorted(r.created_at for r in M.last_turns(rec, 1, "g", "created_at").collect()) == [5]
    assert {r.value: r.n for r in M.histogram(items, "status").collect()} == {"imported": 3, "failed": 2, "needs_review": 1}
