"""Files to cells, regions, headers, facts; and the streaming route."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from granary.operators.materialize import audit, materialize, without_items
from granary.operators.regions import best_headers, find_regions, header_candidates, with_merged, without_formulas_only
from granary.sources.sheets import cells_of, read_folder
from granary.streaming.ingest import ingest


def xlsx(rows, formulas=None, hidden_rows=()):
    formulas = formulas or {}
    strings: list[str] = []
    body = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if ref in formulas:
                cells += f'<c r="{ref}"><f>{formulas[ref]}</f><v>{v}</v></c>'
            elif isinstance(v, str) and v:
                strings.append(v)
                cells += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
            elif v not in ("", None):
                cells += f'<c r="{ref}"><v>{v}</v></c>'
        body += f'<row r="{r}"{" hidden=\"1\"" if r in hidden_rows else ""}>{cells}</row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="表" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


TABLE = [["姓名", "人数", "负责人", "备注"], ["张三", 2, "王五", "低保户"], ["李四", 3, "赵六", ""], ["钱七", "无法识别", "孙八", "待核验"]]


def test_content_decides_the_format():
    got = cells_of("a/b.csv", xlsx([["姓名", "人数"], ["张三", 2]]))
    assert set(got["format"]) == {"xlsx"} and set(got["warning"]) == {"EXTENSION_MISMATCH"} and list(got["value"]) == ["姓名", "人数", "张三", "2"]
    got = cells_of("x.csv", "姓名,人数\n张三,2\n李四,\n".encode("gb18030"))
    assert [tuple(x) for x in got[["row", "col", "value"]].values] == [(1, 1, "姓名"), (1, 2, "人数"), (2, 1, "张三"), (2, 2, "2"), (3, 1, "李四")]
    html = "<html xmlns:x='urn:schemas-microsoft-com:office:excel'><x:Name>Data</x:Name><table><tr><td rowspan=2>a</td><td>b</td></tr><tr style='display: none'><td>c</td></tr></table></html>"
    got = cells_of("x.xls", html.encode())
    assert [tuple(x) for x in got[["sheet_name", "row", "col", "value", "hidden"]].values] == [("Data", 1, 1, "a", False), ("Data", 1, 2, "b", False), ("Data", 2, 2, "c", True)]
    errors = {n: cells_of(n, d)["error"][0] for n, d in (("e", b""), ("z", zip_of("a.txt")), ("b", b"\0\1\2"), ("o.xls", bytes.fromhex("D0CF11E0A1B11AE1") + b"x"))}
    assert errors == {"e": "EMPTY_DOCUMENT", "z": "UNSUPPORTED_ZIP_DOCUMENT", "b": "UNSUPPORTED_DOCUMENT_FORMAT", "o.xls": "XLS_UNSUPPORTED"}


def zip_of(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, "x")
    return out.getvalue()


def test_regions_and_headers(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(xlsx([["姓名", "人数", ""], ["张三", 2, ""], ["李四", 3, "x"], ["", "", ""], ["合计", 5, ""]]))
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "t2.xlsx").write_bytes((tmp_path / "t.xlsx").read_bytes())
    cells = read_folder(spark, str(tmp_path)).persist()
    assert cells.select("path").distinct().count() == 1  # the same content twice
    regions = find_regions(cells)
    bounds = sorted((r.top, r.left, r.bottom, r.right, r.n_cells) for r in regions.collect())
    assert bounds == [(1, 1, 3, 3, 7), (5, 1, 5, 2, 2)]
    head = best_headers(header_candidates(cells, regions)).collect()
    assert [(h.region, h.start, h.depth) for h in head] == [(0, 1, 1)] and [c.path for c in head[0]["columns"]] == ["姓名", "人数"]


def test_merged_headers_of_two_rows(spark):
    """A merged first row gives its text to all its columns; the paths of both rows are the header."""
    rows = [(1, 1, "人员信息", "1"), (1, 3, "联系", "1"), (2, 1, "姓名", "1"), (2, 2, "年龄", "1"), (2, 3, "电话", "1"), (3, 1, "张三", "0"), (3, 2, "30", "0"), (3, 3, "1", "0"), (4, 1, "李四", "0"), (4, 2, "40", "0"), (4, 3, "2", "0")]
    cells = spark.createDataFrame([("w", 0, *x, None, None) for x in rows], "workbook_id string, sheet int, row int, col int, value string, style string, formula string, error string")
    merges = spark.createDataFrame([("w", 0, 1, 1, 1, 2), ("w", 0, 10, 1, 20_000, 2)], "workbook_id string, sheet int, top int, left int, bottom int, right int")
    full = with_merged(cells, merges)
    assert sorted((r.row, r.col, r.value) for r in full.filter("merged").collect()) == [(1, 2, "人员信息")]
    regions = find_regions(full)
    assert [(r.top, r.left, r.bottom, r.right) for r in regions.collect()] == [(1, 1, 4, 3)]
    head = best_headers(header_candidates(full, regions)).first()
    assert (head.start, head.depth) == (1, 2) and [c.path for c in head["columns"]] == ["人员信息 / 姓名", "人员信息 / 年龄", "联系 / 电话"]
    # A body in the header's style speaks against its last row.
    plain = full.withColumn("style", F.lit("0"))
    score = {(r.start, r.depth): r.confidence for r in header_candidates(plain, regions).collect()}
    styled = {(r.start, r.depth): r.confidence for r in header_candidates(full, regions).collect()}
    assert score[(1, 2)] < styled[(1, 2)] and score[(2, 1)] <= styled[(2, 1)]


def test_sparse_column_and_formula_region(spark):
    rows = [("w", 0, r, c, f"v{r}{c}", None) for r in range(1, 6) for c in (1, 2)] + [("w", 0, 3, 4, "far", "=A1")]
    rows += [("w", 1, r, c, "v", None) for r in range(1, 6) for c in (1, 2, 3) if not (c == 3 and r in (2, 4))] + [("w", 1, 3, 2, "v", None)]
    rows = [(*x, None) for x in {x[1:4]: x for x in rows}.values()]
    cells = spark.createDataFrame(rows, "workbook_id string, sheet int, row int, col int, value string, formula string, error string")
    found = find_regions(cells)
    got = sorted((r.sheet, r.top, r.left, r.bottom, r.right) for r in found.collect())
    assert got == [(0, 1, 1, 5, 2), (0, 3, 4, 3, 4), (1, 1, 1, 5, 3)]
    assert sorted((r.sheet, r.left) for r in without_formulas_only(found, cells).collect()) == [(0, 1), (1, 1)]


def test_materialize(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(xlsx(TABLE + [["合计", 5, "", ""]]))
    cells = read_folder(spark, str(tmp_path)).withColumnRenamed("workbook_id", "item_id")
    maps = spark.createDataFrame([(0, 1, "person.name", "text", True, True), (0, 2, "household.size", "integer", False, False), (0, 3, "person.lead", "text", False, False)], "sheet int, col int, code string, data_type string, required boolean, identity boolean")
    facts = materialize(cells, maps, 2, 4)
    assert sorted((r.source_row, r.quality_status) for r in facts.records.collect()) == [(2, "passed"), (3, "passed"), (4, "failed")]
    assert facts.values.count() == 8
    assert [tuple(r)[1:] for r in facts.issues.collect()] == [("normalization_failed", "household.size@B4")]
    assert sorted(r.coordinate for r in facts.lineage.collect()) == ["A2", "A3", "A4", "B2", "B3", "C2", "C3", "C4"]
    assert facts.values.agg(F.sum("integer_value")).first()[0] == 5
    assert {r.violation: r.n for r in audit(facts).collect()} == {"value_without_record": 0, "value_without_lineage": 0, "lineage_without_value": 0, "duplicate_value": 0}
    gone = without_items(facts, facts.records.select("item_id").distinct())
    assert gone.records.count() == gone.values.count() == gone.lineage.count() == gone.issues.count() == 0


def test_quality_rules(spark):
    cells = [("f", 0, 2, 1, "A"), ("f", 0, 3, 1, "A"), ("f", 0, 4, 2, "7"), ("f", 0, 5, 1, "B"), ("f", 0, 5, 2, "#N/A"), ("f", 0, 6, 1, None), ("f", 0, 6, 2, "  ")]
    df = spark.createDataFrame(cells, "item_id string, sheet int, row int, col int, value string")
    maps = spark.createDataFrame([(0, 1, "k", "text", True, True), (0, 2, "n", "integer", False, False)], "sheet int, col int, code string, data_type string, required boolean, identity boolean")
    facts = materialize(df, maps, 2)
    assert sorted(tuple(r) for r in facts.issues.collect()) == [("f:s0:r3", "duplicate_identity", "A"), ("f:s0:r4", "required_missing", "k")]
    held = facts.values.filter("record_id = 'f:s0:r5' and code = 'n'").first()
    assert held.unavailable and held.integer_value is None
    assert materialize(df.limit(0), maps, 1).records.count() == 0


def test_streaming_reads_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    ingest(spark, source, target, checkpoint).awaitTermination(60)
    (tmp_path / "in" / "b.csv").write_text("x,y\n3,4\n5,6\n")
    ingest(spark, source, target, checkpoint).awaitTermination(60)
    assert sorted(r.value for r in spark.read.parquet(target).filter("row > 1").collect()) == ["1", "2", "3", "4", "5", "6"]


def test_spreadsheets_with_misplaced_or_missing_strings():
    """The strings' part is found wherever it is; without it only files whose cells need none can be read."""
    from granary.sources.sheets import SheetError, xlsx_cells

    def book(cell, strings):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="sharedStrings.xml"/></R>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cell}</row></sheetData></worksheet>")
            if strings:
                z.writestr(strings, "<sst><si><t>hello</t></si></sst>")
        return out.getvalue()

    text, number = '<c r="A1" t="s"><v>0</v></c>', '<c r="A1"><v>5</v></c>'
    assert [c[4] for c in xlsx_cells(book(text, "SharedStrings.xml"))] == ["hello"]
    assert [c[4] for c in xlsx_cells(book(number, None))] == ["5"]
    with pytest.raises(SheetError, match="SHARED_STRINGS_MISSING"):
        list(xlsx_cells(book(text, None)))
