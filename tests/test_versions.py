"""Versions of the store, and contents that are ingested once for all batches."""

import pytest
from pyspark.sql import functions as F

from granary.operators.materialize import Facts
from granary.sources import versions as V
from granary.streaming.ingest import ingest, once_each


def facts(spark, rows):
    """rows: plan_id, record_id, value."""
    df = spark.createDataFrame(rows, "plan_id string, record_id string, text_value string")
    return Facts(df.select("plan_id", "record_id"), df, df.select("plan_id", "record_id", F.lit("A1").alias("coordinate")), df.select("plan_id", "record_id", F.lit("x").alias("code")).limit(0))


def plans(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "plan_id string")


def held(f):
    return sorted((r.plan_id, r.text_value) for r in f.values.collect()), f.records.count(), f.lineage.count()


def test_readers_keep_their_version_and_nothing_half_is_seen(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    assert V.versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        V.read(spark, root)
    assert V.commit(spark, root, facts(spark, [("a", "a1", "1"), ("a", "a2", "2"), ("b", "b1", "3")]), plans(spark, "a", "b")) == 1
    early = V.read(spark, root)
    # a again with less, c instead of b, which it supersedes
    assert V.commit(spark, root, facts(spark, [("a", "a1", "9"), ("c", "c1", "4")]), plans(spark, "a", "b", "c")) == 2
    assert held(early) == ([("a", "1"), ("a", "2"), ("b", "3")], 3, 3)
    assert held(V.read(spark, root)) == ([("a", "9"), ("c", "4")], 2, 2) and held(V.read(spark, root, 1)) == held(early)

    # A writer that dies before it has the version leaves nothing that is seen.
    monkeypatch.setattr(V, "_claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        V.commit(spark, root, facts(spark, [("a", "a1", "dead")]), plans(spark, "a"))
    monkeypatch.undo()
    assert V.versions(spark, root) == [1, 2] and held(V.read(spark, root)) == ([("a", "9"), ("c", "4")], 2, 2)

    # Two writers from one version: the slower one builds on the faster one's.
    real = V._claim

    def late(spark_, root_, version, folder):
        monkeypatch.undo()
        V.commit(spark, root, facts(spark, [("d", "d1", "5")]), plans(spark, "d"))
        return real(spark_, root_, version, folder)

    monkeypatch.setattr(V, "_claim", late)
    assert V.commit(spark, root, facts(spark, [("e", "e1", "6")]), plans(spark, "e")) == 4
    assert held(V.read(spark, root))[0] == [("a", "9"), ("c", "4"), ("d", "5"), ("e", "6")]

    assert V.commit(spark, root, None, plans(spark, "a", "e")) == 5
    assert held(V.read(spark, root))[0] == [("c", "4"), ("d", "5")]
    assert len(V.unused(spark, root)) == 3 and V.versions(spark, root) == [5]
    assert held(V.read(spark, root))[0] == [("c", "4"), ("d", "5")]


def test_a_content_is_stored_once_for_all_batches(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    stored = lambda: [(r.owner, r.value) for r in spark.read.parquet(target).filter("row > 1 and col = 1").collect()]
    owner = lambda files: files.withColumn("owner", F.when(F.col("path").contains("u2"), "u2"))

    def put(name, text):
        (tmp_path / "in" / name).write_text(text)
        ingest(spark, source, target, checkpoint, owner=owner).awaitTermination(60)

    put("a.csv", "x,y\n1,2\n")
    put("same.csv", "x,y\n1,2\n")  # another batch, no owner again
    put("u2.csv", "x,y\n1,2\n")  # another owner
    put("b.csv", "x,y\n3,4\n")
    assert sorted(stored(), key=str) == sorted([(None, "1"), (None, "3"), ("u2", "1")], key=str)
    # After a restart that has lost the checkpoint all files come again, as later batches.
    ledger = f"{target}/_contents"
    again = spark.read.format("binaryFile").load(source)
    assert once_each(spark, owner(again), 99, ledger).count() == 0
    # A batch that runs again gives what it gave: it doesn't meet itself.
    first = again.filter(F.col("path").endswith("/a.csv"))
    assert once_each(spark, owner(first), 0, ledger).count() == 1
