"""The layers of template matching against plain loops, and whole workbooks from cells to routes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import layers as T

HEADERS = "region_id long, header_id string, labels array<string>, columns long, header_depth long, kind string, fingerprint string, source string, confidence double, is_default boolean, header_rows long, column_ids array<string>"
VERSIONS = "version_id string, labels array<string>, columns long, header_depth long, kind string, fingerprint string, validated boolean, bound array<string>"
EVIDENCE = "version_id string, source string, region_id long"


def jaccard(a, b):
    x, y = set(a[0]), set(b[0])
    off = (a[1] != b[1]) + (x != y and a[2] != b[2]) + (None not in (a[3], b[3]) and "unknown" not in (a[3], b[3]) and a[3] != b[3])
    return max(0, round(10000 * len(x & y) / len(x | y)) - 750 * off) if x | y else 0


@pytest.mark.parametrize("seed", range(3))
def test_headers_and_regions_match_a_plain_loop(spark, seed):
    r = random.Random(seed)
    names = [f"h{i}" for i in range(9)]
    some = lambda: sorted(r.sample(names, r.randrange(1, 6)))
    versions = [(f"v{i:02}", some(), r.randrange(1, 5), r.randrange(1, 3), r.choice(["table", "form", None, "unknown"]), r.choice([None, f"f{r.randrange(6)}"]), r.random() < 0.3, r.sample(["a", "b", "c"], 2)) for i in range(14)]
    headers = [(g, f"{g}:{k}", some(), r.randrange(1, 5), r.randrange(1, 3), r.choice(["table", "form", "unknown"]), r.choice([None, f"f{r.randrange(20)}"]), f"s{g % 4}", r.choice([0.5, 0.7]), k == 0, r.randrange(1, 3), ["a", "c"]) for g in range(60) for k in range(r.randrange(1, 4))]
    evidence = [(r.choice(versions)[0], f"s{g % 4}", g) for g in r.sample(range(60), 6)]
    tables = [spark.createDataFrame(x, s) for x, s in ((headers, HEADERS), (versions, VERSIONS), (evidence, EVIDENCE))]
    got = {x.region_id: x for x in T.match_regions(T.best_headers(*tables), tables[1], tables[2]).collect()}
    for g in range(60):
        proved = {v for v, s, x in evidence if x == g and s == f"s{g % 4}"}
        ranked = []
        for h in (h for h in headers if h[0] == g):
            near = min(((-jaccard(h[2:6], v[1:5]), v[0]) for v in versions), default=(0, None))
            same = {v[0] for v in versions if h[6] is not None and v[5] == h[6]}
            ranked.append((not proved, not same, near[0], -h[8], not h[9], h[10], h[1], near[1] if near[0] else None, same))
        _, _, score, _, _, _, header, version, same = min(ranked, key=lambda x: x[:7])
        able = [v for v in versions if v[0] in proved | same]
        if able:
            best = max(able, key=lambda v: (v[0] in proved, v[6], len({"a", "c"} & set(v[7])), v[0]))
            want = (header, best[0], 10000, "exact", "region_template_fingerprint")
        else:
            kind = "exact" if score == -10000 else "partial" if score else "none"
            want = (header, version, -score, kind, "normalized_region_signature" if kind == "exact" else None)
        assert (got[g].header_id, got[g].version_id, got[g].score, got[g].match_type, got[g].matched_by) == want


@pytest.mark.parametrize("seed", range(3))
def test_slots_match_a_plain_loop(spark, seed):
    r = random.Random(seed)
    parts = [(o, r.choice("ABCD"), f"p{i}") for o in range(80) for i in range(r.randrange(0, 6))] + [(5, None, "p9")]
    slots = [(f"e{k}", f"s{i}", i, r.choice("ABCD"), r.random() < 0.6, r.random() < 0.5) for k in range(12) for i in range(r.randrange(1, 5))]
    entries = sorted({s[0] for s in slots})
    table, filled = T.match_slots(spark.createDataFrame([(o,) for o in range(80)], "owner_id long"), spark.createDataFrame(parts, "owner_id long, member string, part_id string"), spark.createDataFrame(slots, "entry_id string, slot_key string, ordinal int, member string, required boolean, materialize boolean"))
    got, placed = {x.owner_id: x for x in table.collect()}, sorted(map(tuple, filled.collect()))
    want_placed = []
    for o in range(80):
        best = (0, None)
        for e in entries:
            left, missing, taken = [(m, p) for x, m, p in parts if x == o and m], [], []
            expected = [s for s in slots if s[0] == e]
            for _, key, _, member, required, keep in expected:
                hit = next((x for x in left if x[0] == member), None)
                if hit:
                    left.remove(hit)
                    taken.append((o, key, hit[1], keep))
                elif required:
                    missing.append(key)
            score = max(0, round(10000 * len(taken) / len(expected)) - 500 * len(left))
            if score > best[0]:
                best = (score, e, len(expected), len(taken), missing, sorted(m for m, _ in left), taken)
        x = got[o]
        if best[1] is None:
            assert (x.entry_id, x.score, x.match_type, x.total_slots, x.matched_slots) == (None, 0, "none", 0, 0)
            continue
        want_placed += best[6]
        exact = not best[4] and not best[5] and best[2] == best[3]
        assert (x.score, x.entry_id, x.total_slots, x.matched_slots, x.missing, x.unknown, x.match_type) == (*best[:6], "exact" if exact else "partial")
        assert x.coverage == round(10000 * best[3] / best[2])
    assert placed == sorted(want_placed)


def test_equal_sets_are_one_and_rare_members_come_first(spark):
    """A member that all sets hold makes no pairs where a rarer one tells them apart."""
    left = spark.createDataFrame([(i, ["all", f"own{i % 50}", f"more{i % 50}"]) for i in range(2000)], "left_id long, keys array<string>").withColumn("told", F.struct(F.lit(0).alias("none")))
    right = spark.createDataFrame([(f"r{i:02}", ["all", f"own{i}", f"more{i}"]) for i in range(50)], "right_id string, keys array<string>").withColumn("told", F.struct(F.lit(0).alias("none")))
    seen = []
    real = T.written

    def counted(df):
        out = real(df)
        if "shared" in out.columns:
            seen.append(out.count())
        return out

    T.written, before = counted, T.written
    try:
        found = T.best_covered(left, right, T.slot_score)
        assert {x.score for x in found.collect()} == {10000} and found.count() == 2000
    finally:
        T.written = before
    assert seen == [50, 0, 0, 0]  # fifty distinct sets, settled by the highest bound


def test_forms_by_their_anchors_and_fields_by_their_meaning(spark):
    cells = spark.createDataFrame([("s", 3, 2, "姓 名"), ("s", 3, 3, "张三"), ("s", 4, 2, "电话"), ("s", 9, 9, "姓名")], "sheet_id string, row int, col int, value string")
    regions = spark.createDataFrame([("s", 1, 3, 2, 4, 3), ("s", 2, 9, 9, 9, 9)], "sheet_id string, region_id long, top int, left int, bottom int, right int")
    anchors = spark.createDataFrame([("v1", 0, 0, "姓名"), ("v1", 1, 0, "电话"), ("v2", 0, 0, "姓名"), ("v2", 1, 0, "地址"), ("v3", 0, 0, "姓名")], "version_id string, row_offset int, col_offset int, label string")
    forms = T.anchored(cells, regions, anchors)
    assert [tuple(x) for x in forms.collect()] == [(1, "v1")]
    headers = [(1, "1:0", ["姓名", "x"], 2, 1, "form", None, "s", 0.9, True, 1, []), (2, "2:0", ["姓名", "手机"], 2, 1, "table", None, "s", 0.9, True, 1, [])]
    versions = [("v1", ["姓名", "电话"], 2, 1, "form", None, False, []), ("v2", ["姓名", "电话号码"], 2, 1, "table", None, False, []), ("v9", ["姓名", "地址", "手机"], 3, 1, "table", None, False, [])]
    h, v, e = spark.createDataFrame(headers, HEADERS), spark.createDataFrame(versions, VERSIONS), spark.createDataFrame([], EVIDENCE)
    fields = spark.createDataFrame([(2, "name"), (2, "phone"), (1, None)], "region_id long, code string")
    of_version = spark.createDataFrame([("v2", "phone"), ("v2", "name"), ("v9", "name"), ("v9", "phone"), ("v9", "address")], "version_id string, code string")
    got = {x.region_id: (x.version_id, x.match_type, x.matched_by) for x in T.match_regions(T.best_headers(h, v, e), v, e, forms, fields, of_version).collect()}
    assert got == {1: ("v1", "exact", "region_template_fingerprint"), 2: ("v2", "exact", "semantic_field_signature")}


def test_region_templates_are_reused_across_workbooks(spark):
    """Two sheets of any name, people and land: regions, compositions, the route and the summary are exact."""
    regions = [(1, "people", ["姓名", "人数"]), (2, "land", ["地块", "面积"]), (3, "people2", ["姓名", "人数"])]
    h = spark.createDataFrame([(g, f"{g}:0", labels, 2, 1, "table", None, "book", 0.9, True, 1, []) for g, _, labels in regions], HEADERS)
    v = spark.createDataFrame([("people@1", ["姓名", "人数"], 2, 1, "table", None, False, []), ("land@1", ["地块", "面积"], 2, 1, "table", None, False, [])], VERSIONS)
    e = spark.createDataFrame([], EVIDENCE)
    matched = T.match_regions(T.best_headers(h, v, e), v, e)
    place = spark.createDataFrame([(g, s, "book" if g < 3 else "other") for g, s, _ in regions], "region_id long, sheet string, item_id string")
    at = matched.join(place, "region_id")
    assert {tuple(x) for x in T.match_items(at).collect()} == {("book", 2, 2, 10000, 10000, "exact", None), ("other", 1, 1, 10000, 10000, "exact", "people@1")}
    slot = "entry_id string, slot_key string, ordinal int, member string, required boolean, materialize boolean"
    exact = at.filter("match_type = 'exact'").select(F.col("sheet").alias("owner_id"), F.col("version_id").alias("member"), F.col("region_id").cast("string").alias("part_id"))
    sheets, _ = T.match_slots(place.select(F.col("sheet").alias("owner_id")), exact, spark.createDataFrame([("people-sheet", "main", 0, "people@1", True, True), ("land-sheet", "main", 0, "land@1", True, True)], slot))
    assert Counter(x.entry_id for x in sheets.collect() if x.match_type == "exact") == {"people-sheet": 2, "land-sheet": 1}
    parts = sheets.filter("match_type = 'exact'").join(place.select("sheet", "item_id"), F.col("owner_id") == F.col("sheet")).select(F.col("item_id").alias("owner_id"), F.col("entry_id").alias("member"), F.col("sheet").alias("part_id"))
    routes, filled = T.match_slots(place.select(F.col("item_id").alias("owner_id")), parts, spark.createDataFrame([("route", "people", 0, "people-sheet", True, True), ("route", "land", 1, "land-sheet", True, False)], slot))
    got = {x.owner_id: (x.entry_id, x.match_type, x.score, x.missing) for x in routes.collect()}
    assert got == {"book": ("route", "exact", 10000, []), "other": ("route", "partial", 5000, ["land"])}
    assert ("book", "land", "land", False) in {tuple(x) for x in filled.collect()}


def test_nothing_published_matches_nothing(spark):
    h, v, e = spark.createDataFrame([(1, "1:0", ["a"], 1, 1, "table", None, "s", 0.9, True, 1, [])], HEADERS), spark.createDataFrame([], VERSIONS), spark.createDataFrame([], EVIDENCE)
    assert [(x.version_id, x.score, x.match_type) for x in T.match_regions(T.best_headers(h, v, e), v, e).collect()] == [(None, 0, "none")]


def test_every_variant_of_an_entry_is_met(spark):
    none = F.struct(F.lit(0).alias("none")).alias("told")
    left = spark.createDataFrame([(1, ["c", "d"]), (2, ["a"])], "left_id long, keys array<string>").select("*", none)
    right = spark.createDataFrame([("v", ["a", "b"]), ("v", ["c", "d"])], "right_id string, keys array<string>").select("*", none)
    assert {tuple(x) for x in T.best_covered(left, right, T.slot_score).collect()} == {(1, "v", 10000, 2), (2, "v", 5000, 1)}


@pytest.mark.parametrize("both", [False, True])
def test_sets_of_many_keys_match_a_plain_loop(spark, monkeypatch, both):
    """With more keys than fit into the bits of a number, and a catalog that isn't sent to tasks."""
    monkeypatch.setattr(T, "SENT", 0)
    r = random.Random(both)
    names = [f"k{min(int(r.expovariate(0.02)), 199)}" for _ in range(2000)]
    some = lambda: sorted(set(r.sample(names, r.randrange(1, 9))))
    entries = [(f"e{i:02}", some(), i % 3) for i in range(40)]
    sets = [(i, some() if i % 4 else r.choice(entries)[1][: r.randrange(1, 9)] + ["k0"], i % 3) for i in range(120)]
    shape = lambda df: df.withColumn("told", F.struct(F.col("t").alias("columns"), F.lit(1).alias("header_depth"), F.lit(None).cast("string").alias("kind"))).drop("t")
    left, right = shape(spark.createDataFrame(sets, "left_id long, keys array<string>, t long")), shape(spark.createDataFrame(entries, "right_id string, keys array<string>, t long"))
    got = {x.left_id: (x.right_id, x.score) for x in T.best_covered(left, right, T.header_score if both else T.slot_score, both=both).collect()}
    for i, keys, t in sets:
        a = set(keys)
        scored = [(-(jaccard((a, t, 1, None), (b, u, 1, None)) if both else max(0, round(10000 * len(a & set(b)) / len(b)) - 500 * len(a - set(b)))), e) for e, b, u in entries if a & set(b)]
        behind, e = min(scored, default=(0, None))
        assert got.get(i) == ((e, -behind) if behind else None)


def test_owners_of_equal_members_are_one(spark, monkeypatch):
    """What is scored, missing and unknown is told once for all owners of the same members, however many parts they have."""
    seen, real = [], T.written
    monkeypatch.setattr(T, "written", lambda df: seen.append((set(df.columns), df.count())) or real(df))
    parts = spark.createDataFrame([(o, m, f"p{o}{i}") for o in range(300) for i, m in enumerate("AAB" if o % 2 else "AC")], "owner_id long, member string, part_id string")
    slots = spark.createDataFrame([("e", f"s{i}", i, m, True, True) for i, m in enumerate("AAB")], "entry_id string, slot_key string, ordinal int, member string, required boolean, materialize boolean")
    table, filled = T.match_slots(parts.select("owner_id"), parts, slots)
    got = {(x.owner_id % 2, x.score, tuple(x.missing), tuple(x.unknown), x.match_type) for x in table.collect()}
    assert got == {(1, 10000, (), (), "exact"), (0, 2833, ("s1", "s2"), ("C",), "partial")} and table.count() == 300
    assert filled.count() == 600 and {tuple(x) for x in filled.filter("owner_id = 1").collect()} == {(1, "s0", "p10", True), (1, "s1", "p11", True), (1, "s2", "p12", True)}
    assert max(n for columns, n in seen if "score" in columns) == 2
