"""A sheet with numbered rows, a sum, a bare number and a form's own texts; and dates, forms and redaction."""

import io
import zipfile

from pyspark.sql import functions as F

from granary.functions import values as V
from granary.operators.materialize import materialize
from granary.sources.sheets import date_styles, date_text, xlsx_cells


def cells_and_maps(spark):
    rows = [["序号", "姓名", "人数", ""], ["1", "张三", "2", "备注"], ["2", "李四", "3", ""], ["3", "钱七", "无法识别", ""], ["合计", "", "5", ""], ["4", "", "", ""], ["", "姓名", "（一）本表由本人填写", "签名："]]
    cells = [("f1", 0, r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    maps = [(0, 1, "base.sequence_number", "integer", False, False), (0, 2, "person.name", "text", False, True), (0, 3, "household.size", "integer", False, False)]
    return spark.createDataFrame(cells, "item_id string, sheet int, row int, col int, value string"), spark.createDataFrame(maps, "sheet int, col int, code string, data_type string, required boolean, identity boolean")


def ITEMS(spark):  # noqa: N802
    return spark.createDataFrame([("f1", "t1", "v1", "tpl", 1, "p1", "a.xlsx", "x/a.xlsx", "00")], "item_id string, tenant_id string, unit_id string, template_id string, template_version int, approved_plan_id string, file_name string, relative_path string, source_sha256 string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def test_records_are_rows_with_data(spark):
    cells, maps = cells_and_maps(spark)
    facts = materialize(cells, maps, 2)
    assert sorted((r.source_row, r.quality_status) for r in facts.records.collect()) == [(2, "passed"), (3, "passed"), (4, "failed")]


def test_unfilled_texts(spark):
    texts = {"": True, "姓名": True, "户主姓名": True, "（一）说明": True, "1、填写": True, "申请人签名：": True, "起止时间 月 日": True, "起止时间3月1日": False, "张三": False, "这是一个很长很长的名字叫做姓名": False, None: False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.unfilled(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == texts


def test_redaction(spark):
    texts = {"男": ("category", "男"), " ": ("empty", None), None: ("empty", None), "tel 13800000000": ("identifier_like", "<DIGITS:11>"), "2024-1-2": ("date_like", "2024-1-2"), "2024.03": ("date_like", "2024.03"), "张 三": ("cn_text", "<CN_TEXT:3:")}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.redact(F.col("t"), F.array(F.lit("男"))).alias("r"))
    for r in df.collect():
        kind, shown = texts[r.t]
        assert r.r.kind == kind and (r.r.shown == shown or (shown and r.r.shown.startswith(shown)))


def test_dates_of_spreadsheets():
    styles = b'<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;year&quot;m"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]0"/><numFmt numFmtId="167" formatCode="[h]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="167"/></cellXfs></styleSheet>'
    assert date_styles(styles) == {"1", "2", "5"} and date_styles(None) == set()
    assert [date_text(s, False) for s in ("1", "59", "61", "45292", "45292.75", "0.5", "x", "-3")] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-01", "2024-01-01T18:00:00", "12:00:00", "x", "-3"]
    assert date_text("43830", True) == "2024-01-01"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="urn:r"><workbookPr date1904="0"/><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" s="1"><v>45292</v></c><c r="B1" s="0"><v>45292</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" t="e"><v>#N/A</v></c><c r="E1" s="1" t="str"><v>45</v></c></row></sheetData></worksheet>')
    assert [c[4] for c in xlsx_cells(out.getvalue())] == ["2024-01-01", "45292", "true", "#N/A", "45"]
