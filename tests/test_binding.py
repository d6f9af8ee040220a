"""Bindings to columns against a plain loop."""

import random

from granary.operators.binding import bind_columns


def plain(bindings, columns, projected):
    out = {}
    for region in {b[0] for b in bindings}:
        own, there = [b for b in bindings if b[0] == region], [c for c in columns if c[0] == region]
        for _, i, source, path in own:
            path = [p for p in path if p]
            alike = lambda c: [p for p in c[4] if p] == path  # noqa: B023, E731
            same_leaf = lambda c: bool(path) and [p for p in c[4] if p][-1:] == path[-1:]  # noqa: B023, E731
            exact = [c for c in there if c[3] == source]
            said = next((p for p in sorted(projected) if p[0] == region and p[2] == source), None)
            headed = [c for c in there if path and alike(c)]
            number = int(source.rsplit(":column:", 1)[1]) if ":column:" in source else 0
            physical = [c for c in there if c[2] == number and (path and alike(c) or same_leaf(c))]
            if len(exact) == 1:
                found = exact[0], "source_id"
            elif said:
                c = next((c for c in there if c[1] == said[3]), None)
                found = (c, "offset") if c and path and alike(c) else (None, None)
            elif len(headed) == 1:
                found = headed[0], "path"
            elif len(physical) == 1:
                found = physical[0], "physical_column"
            elif len(own) == len(there) and path and alike(there[i]):
                found = there[i], "ordinal"
            else:
                found = None, None
            out[region, i] = (found[0][1] if found[0] else None, found[1])
    return out


def test_bindings(spark):
    r = random.Random(8)
    path = lambda: r.choice([["a"], ["b"], ["x", "a"], ["x", "b"], ["", "a"], []])
    source = lambda: r.choice(["s1", "s2", "f:column:1", "f:column:2", "f:column:3", "?"])
    bindings, columns, projected = [], [], []
    for g in range(150):
        n = r.randrange(1, 5)
        columns += [(f"g{g}", i, i + 1, source(), path()) for i in range(n)]
        bindings += [(f"g{g}", i, source(), path()) for i in range(r.choice([n, n, r.randrange(1, 5)]))]
        projected += [(f"g{g}", i, source(), r.randrange(4)) for i in range(r.choice([0, 0, 2]))]
    got = bind_columns(
        spark.createDataFrame(bindings, "region_id string, ordinal long, source_column_id string, header_path array<string>"),
        spark.createDataFrame(columns, "region_id string, place long, col int, source_column_id string, header_path array<string>"),
        spark.createDataFrame(projected, "region_id string, position int, source_column_id string, offset long"),
    ).collect()
    want = plain(bindings, columns, projected)
    assert {(x.region_id, x.ordinal): (x.place, x.matched_by) for x in got} == want and len(got) == len(bindings)
    assert {how for _, how in want.values()} == {"source_id", "offset", "path", "physical_column", "ordinal", None}


def test_titles_above_a_path_do_not_part_it(spark):
    b = spark.createDataFrame([("g", 0, "?", ["人员登记表", "姓名"])], "region_id string, ordinal long, source_column_id string, header_path array<string>")
    c = spark.createDataFrame([("g", 0, 1, "c1", ["姓名"]), ("g", 1, 2, "c2", ["电话"])], "region_id string, place long, col int, source_column_id string, header_path array<string>")
    assert [tuple(x) for x in bind_columns(b, c).collect()] == [("g", 0, 0, "path")]
