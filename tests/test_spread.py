"""Large sheets and CSV files, spread over tasks, against what one task makes of them."""

import io
import random
import zipfile

import pytest

from granary.operators import regions as R
from granary.operators.regions import best_headers, find_regions, header_candidates, regions_by_sheet, regions_spread, with_merged
from granary.sources.csv_lines import read_csv
from granary.sources.sheets import csv_cells, read_cells, read_merges


def test_spread_regions_are_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(R, "BAND", 4)
    r = random.Random(2)
    rows = set()
    for s in range(14):
        height, width, full = r.randrange(1, 40), r.randrange(1, 12), r.choice([0.15, 0.4, 0.6, 0.9])
        rows |= {("w", s, i, j) for i in range(1, height + 1) for j in range(1, width + 1) if r.random() < full}
    # a snake, a frame with a cell inside, and a cross that doesn't touch its frame
    rows |= {("w", 20, i, j) for i in range(1, 30) for j in range(1, 9) if i % 2 or j == (8 if i % 4 else 1)}
    rows |= {("w", 21, i, j) for i in range(1, 20) for j in range(1, 20) if i in (1, 19) or j in (1, 19) or (i, j) == (9, 9) or i == 5 and 4 < j < 9}
    there = spark.createDataFrame(sorted(rows) + sorted(rows)[:5], "workbook_id string, sheet int, row int, col int").repartition(4)
    want = sorted(map(tuple, regions_by_sheet(there).collect()))
    assert sorted(map(tuple, regions_spread(there).select(*[c.split()[0] for c in R.REGIONS.split(", ")]).collect())) == want
    cells = there.selectExpr("*", "cast(null as string) as error")
    assert sorted(map(tuple, find_regions(cells, most=60).collect())) == want


def test_merges_come_from_the_file(spark):
    """A two-row header with merged cells is read from an xlsx file as its paths."""
    out = io.BytesIO()
    texts = [["人员信息", None, "联系"], ["姓名", "年龄", "电话"], ["张三", "30", "1"], ["李四", "40", "2"]]
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{"ABC"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(texts, 1))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet><sheetData>{body}</sheetData><mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    files = spark.createDataFrame([("a.xlsx", bytearray(out.getvalue())), ("b.csv", bytearray(b"x,y\n1,2\n")), ("c.xlsx", bytearray(b"PK\x03\x04broken"))], "path string, content binary")
    merges = read_merges(files)
    assert [tuple(m)[1:] for m in merges.collect()] == [(0, 1, 1, 1, 2)]
    cells = with_merged(read_cells(files).filter("path = 'a.xlsx'"), merges)
    head = best_headers(header_candidates(cells, find_regions(cells))).first()
    assert (head.start, head.depth) == (1, 2) and [c.path for c in head["columns"]] == ["人员信息 / 姓名", "人员信息 / 年龄", "联系 / 电话"]


def random_csv(r):
    d = r.choice(",;|\t")
    value = lambda: r.choice(["", "a", "12", 'in "the" middle', "x\ny", 'say ""hi"" now', "r\r\nn", f"p{d}q", "é中", '5" pipe', "\n", '"'])

    def shown(v):
        if r.random() < 0.3 or any(c in v for c in d + "\n\r") or v.startswith('"'):
            return '"' + v.replace('"', '""') + '"' + r.choice(["", "", "tail"])
        return v

    lines = [d.join(shown(value()) for _ in range(4)) for _ in range(22)]
    return r.choice(["\n", "\r\n"]).join(["h1" + d + "h2" + d + "h3" + d + "h4"] * 3 + lines) + r.choice(["", "\n"])


@pytest.mark.parametrize("split", [150, 900])
def test_csv_cells_do_not_hang_on_where_files_are_cut(spark, tmp_path, split):
    r = random.Random(split)
    want = set()
    for i in range(3):
        text = random_csv(r)
        data = text.encode("gb18030") if i == 1 else (b"\xef\xbb\xbf" if i == 2 else b"") + text.encode()
        (tmp_path / f"f{i}.csv").write_bytes(data)
        want |= {(f"f{i}.csv", row, col, value) for _, _, row, col, value, *_ in csv_cells(data)}
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "plain.csv").write_bytes(b"no delimiter\nhere\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        cells = read_csv(spark, str(tmp_path))
        got = {(x.path.rpartition("/")[2], x.row, x.col, x.value) for x in cells.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == want
