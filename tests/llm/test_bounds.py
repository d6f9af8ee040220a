"""What is sent to every task below a bound is joined by a shuffle above it, with equal results; and what prefix filters leave out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import jaccard, langid
from tests.test_entry import DATA


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(40)) for _ in range(60)) for _ in range(12)]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(i, base[i % 12] + (f" x{i}" if i > 12 else ""), "en" if i % 2 else "de", f"s{i % 3}", 1) for i in range(40)] + [(90, "so " + bench + " it goes", "en", "s1", 1), (None, base[3], None, None, None), (5, "other words for the same id", "en", "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.mark.parametrize("stage", ["jaccard_join", "decontaminate"])
def test_stages_do_not_hang_on_what_is_sent(spark, docs, monkeypatch, stage):
    run = lambda: Counter(map(tuple, getattr(corpus_pipeline, stage)(spark, docs, DATA).collect()))
    sent = run()
    monkeypatch.setattr(corpus_pipeline, "SENT", -1)
    assert run() == sent and 0 < sum(sent.values()) < docs.count()


def test_samples_do_not_hang_on_what_is_sent(docs, monkeypatch):
    labelled = docs.select("doc_id", "text", F.col("lang").alias("label"))
    sent = langid.sample_texts(labelled, 10)
    monkeypatch.setattr(langid, "SENT", -1)
    assert langid.sample_texts(labelled, 10) == sent and len(sent) > 10


def test_prefixes_under_other_orders_leave_pairs_out_before_sets_meet(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(30):
        text = r.sample(words, 120)
        rows += [(4 * i, " ".join(text)), (4 * i + 1, " ".join([*text[:118], "end", "of"])), (4 * i + 2, " ".join([*text[:60], *r.sample(words, 60)])), (4 * i + 3, " ".join([*text[:85], *r.sample(words, 35)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    sketch = jaccard.sketches(docs, 3, 90, 3, 9, jaccard.np.zeros(0, jaccard.np.uint64))
    nodes = jaccard.saved(sketch.select("node", F.struct("doc_id", "text_hash").alias("rep")), "nodes")
    of = nodes.select("node", "rep.doc_id", F.floor(F.col("rep.doc_id") / 4).alias("family"))
    a, b = of.toDF("x", "dx", "family"), of.toDF("y", "dy", "family")
    inside = a.join(b, "family").filter("dx < dy").select("x", "y")
    across = a.join(b.withColumnRenamed("family", "other"), F.col("other") == F.col("family") + 1).select("x", "y")
    pairs = inside.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = {strict: {(r.a, r.b): r.distance for r in jaccard.verified(pairs.withColumn("strict", F.lit(strict)), nodes, docs, 3, 90).collect()} for strict in (False, True)}
    assert len(found[False]) == 30 * 6 + 29 * 16
    links = {p: d for p, d in found[False].items() if d <= 0.1 + 1e-12}
    assert len(links) == 30 and links.items() <= found[True].items() <= found[False].items()
    # Sets that have hardly a token in common are never intersected; those that have a third still are.
    assert len(found[True]) <= 30 * 6 and max(found[True].values()) < 0.9 < max(found[False].values())
