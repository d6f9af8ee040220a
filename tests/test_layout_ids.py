"""Ids of sheets and cells, signatures of regions, fingerprints of layouts."""

import hashlib
import json

from granary.operators.fields import layout_fingerprints, region_signatures
from granary.sources.sheets import with_ids


def test_ids(spark):
    cells = spark.createDataFrame([("workbook:ab", 0, 3, 2), ("workbook:ab", None, None, None)], "workbook_id string, sheet int, row int, col int")
    assert {(x.sheet_id, x.cell_id) for x in with_ids(cells).collect()} == {("workbook:ab:sheet:0", "workbook:ab:sheet:0:r3:c2"), (None, None)}


def test_signatures_do_not_hang_on_the_kind(spark):
    rows = [("a", "table", [["表", "姓名"], ["表", "电话"]]), ("b", "form", [["表", "姓名"], ["表", "电话"]]), ("c", "table", [["姓名"], ["电话"]]), ("d", "table", [["表", "电话"], ["表", "姓名"]]), ("e", "table", [])]
    got = {x.region_id: x for x in region_signatures(spark.createDataFrame(rows, "region_id string, kind string, paths array<array<string>>")).collect()}
    assert got["a"].fingerprint == got["b"].fingerprint and len({x.fingerprint for x in got.values()}) == 4
    assert (got["a"].columns, got["a"].header_depth, got["e"].columns, got["e"].header_depth) == (2, 2, 0, 0)


def test_layouts(spark):
    """Equal to the digest of the same JSON made by hand; order of regions, white space and names of sheets don't matter."""
    workbooks = spark.createDataFrame([("w1", "xlsx"), ("w2", "xlsx"), ("w3", "csv")], "workbook_id string, format string")
    sheets = spark.createDataFrame([(w, i, i == 1) for w in ("w1", "w2") for i in range(2)] + [("w3", 0, False)], "workbook_id string, sheet int, hidden boolean")
    regions = [("w1", 0, 0, "table", 2, 1, [["姓名"], ["a", " b  c"]]), ("w1", 0, 1, "form", 1, 2, [["x"], ["", " "]]), ("w2", 0, 0, "table", 2, 1, [["姓名"], ["a", "b c"]]), ("w2", 0, 1, "form", 1, 2, [["x"]])]
    df = spark.createDataFrame(regions, "workbook_id string, sheet int, region int, kind string, width int, header_rows int, paths array<array<string>>")
    got = {x.workbook_id: x.fingerprint for x in layout_fingerprints(workbooks, sheets, df).collect()}
    signature = {"format": "xlsx", "headers": [["a", "b c"], ["x"], ["姓名"]], "sheets": [{"hidden": False, "regions": [{"columns": 1, "header_depth": 2, "kind": "form"}, {"columns": 2, "header_depth": 1, "kind": "table"}]}, {"hidden": True, "regions": []}]}
    want = hashlib.sha256(json.dumps(signature, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got["w1"] == got["w2"] == want != got["w3"]
