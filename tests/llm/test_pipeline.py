"""The pipeline's stages, each held against plain Python on its own input, and the registered operator queries against their SQL."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from granary.llm import queries as llm
from tests.llm.test_edges import brute_components, brute_hits, brute_spans
from tests.test_entry import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that enter each stage, and what leaves the last."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(100_001, "123 456 !!", "en", "src1", 10), (100_002, None, None, None, None), (100_003, "", "de", "src2", 0)], docs.schema)
    out = [docs.unionByName(extra)]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], DATA)
        path = str(tmp_path_factory.mktemp("p") / name)
        made.write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()] for df in out], [df.columns for df in out]


def test_columns_and_language(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:-1])
    assert set(rows[0]) - set(rows[1]) == {r for r in rows[0] if r[0] > 100_000}  # clean documents stay


def test_one_of_each_group_stays(stages):
    rows, _ = stages
    keep = {d for _, d, _, c in brute_components([r[:2] for r in rows[1]]) if d == c}
    assert Counter(rows[2]) == Counter(r for r in rows[1] if r[0] in keep)


def test_null_and_repeated_ids_lose_only_near_copies(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    near = lambda k, n: f"{text[k]} tail{n}"
    rows = [
        (1, text["a"]), (None, near("a", 1)), (None, text["b"]),  # a null id near a document with an id, and a clean one
        (3, text["c"]), (5, near("c", 1)), (5, text["d"]),  # of two texts with one id, one is a copy
        (None, text["e"]), (None, near("e", 1)), (None, near("e", 2)),  # one of a group without ids stays
        (7, text["f"]), (7, near("f", 1)),  # near copies with one id
        (None, ""), (8, "123"), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.jaccard_join(spark, docs, DATA).collect()]
    sure = [(1, text["a"]), (None, text["b"]), (3, text["c"]), (5, text["d"]), (8, "123")]
    assert Counter(r for r in got if r in sure) == Counter(sure)
    assert sum(r[0] is None and (r[1] or "").startswith("e0") for r in got) == 1 and sum(r[0] == 7 for r in got) == 1
    assert sum(not r[1] for r in got) == 1 and len(got) == len(sure) + 3


def test_stages_take_nulls_repeats_clashing_columns_and_empty_tables(spark):
    """Ids that are null, repeat with equal texts, or with others; columns with the names that stages use inside."""
    r = __import__("random").Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = [" ".join(r.choice(words) for _ in range(60)) for _ in range(8)]
    names = ["_t", "_gone", "_hash", "_bad", "text_hash", "letter", "_copies", "_rate", "_source", "rate", "copy", "node", "spans", "lo", "at", "words", "start", "t", "d", "h"]
    ids = [1, 1, None, 2, 2, None, 4, 5]
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else "s", None, *range(len(names))) for k, (i, t) in enumerate(zip(ids, text, strict=True))]
    rows += [rows[0], rows[2], (7, None, None, None, None, *[None] * len(names)), (8, "", "en", "s", 0, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)).repartition(3)
    empty = docs.limit(0)
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
        made = stage(spark, now, DATA)
        assert sorted(made.columns) == sorted(docs.columns), name
        kept = made.select("doc_id", "text").collect()
        if name == "language_id":
            assert Counter(map(tuple, kept)) == Counter(x[:2] for x in rows if x[1])
            now = docs.join(spark.createDataFrame([(7,), (8,)], "doc_id long"), "doc_id", "left_anti")
            continue
        if name == "jaccard_join":  # every text is of its own; the two repeated rows are one each
            assert Counter(map(tuple, kept)) == Counter(x[:2] for x in rows[:8])
            now = made
        elif name != "mixing":
            assert Counter(map(tuple, kept)) == Counter(x[:2] for x in rows[:8])
        assert name == "mixing" or {tuple(x)[5:-1] for x in made.select("doc_id", "text", "lang", "source", "n_chars", *names).collect()} == {tuple(range(len(names) - 1))}


def test_passages_leave(stages):
    rows, _ = stages
    want = []
    for r, (n, gone, kept) in zip(rows[2], brute_spans([r[1] for r in rows[2]], 35), strict=True):
        if not gone:
            want.append(r)
        elif gone < n:
            want.append((r[0], kept, r[2], r[3], len(kept)))
    assert Counter(rows[3]) == Counter(want)


def test_benchmark_documents_leave(stages, spark):
    rows, _ = stages
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for _, d, _, hit, _ in brute_hits([r[:2] for r in rows[3]], items) if hit}
    assert bad and Counter(rows[4]) == Counter(r for r in rows[3] if r[0] not in bad)


def test_copies(stages):
    rows, columns = stages
    assert columns[-1] == [*columns[0], "copy"]
    known, copies = Counter(rows[4]), Counter(rows[5])
    assert set(copies) <= set(known) and max(copies.values()) <= 3


def test_run_gives_what_the_stages_give(stages, spark):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in stages[0][-1])


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = llm.QUERIES[name](spark, DATA), con.execute(llm.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == plain(columns, want.fetchall())


def test_learned_queries_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = llm.QUERIES["op9_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = llm.QUERIES["op6_quality"](spark, folder).join(labels, "doc_id").filter("held_out")
    assert found.filter("predicted = quality").count() >= 0.95 * found.count()
    found = llm.QUERIES["op8_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out")
    assert found.filter("predicted = toxic").count() >= 0.9 * found.count()
