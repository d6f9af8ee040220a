"""Workbooks of questions, ISO weeks, integers with long fractions, and payloads."""

import datetime
import random

from pyspark.sql import functions as F

from granary.functions import payload as J
from granary.functions.values import normalize
from granary.operators.questions import read_questions


def test_questions_of_a_workbook(spark):
    rows = {
        0: {1: ["题库"], 3: ["序号", "所属村委", "提问", "参考表格", "预期答案", "用时", "提问"], 4: ["1", "甲村", "有多少人", "a.xlsx", "5", "2s", "x"], 5: ["2", "", "有 多少人", "", "6", "", ""], 6: ["3", "乙村", "谁最大", "", "", "", ""], 7: ["4", "", "", "b.xlsx"], 8: ["5", "", "几户"]},
        1: {1: ["h", "h"], 2: ["", "b1"], 3: ["x", "b2"]},
    }
    cells = [("w", s, f"S{s}", r, c, v) for s, body in rows.items() for r, values in body.items() for c, v in enumerate(values, 1) if v]
    questions, other = read_questions(spark.createDataFrame(cells, "workbook_id string, sheet int, sheet_name string, row int, col int, value string"))
    got = {x.row: x for x in questions.collect()}
    assert {r: (x.question, x.village, x.reference) for r, x in got.items()} == {4: ("有多少人", "甲村", "a.xlsx"), 5: ("有 多少人", "甲村", "a.xlsx"), 6: ("谁最大", "乙村", ""), 8: ("几户", "乙村", "b.xlsx")}
    assert got[4].earlier == {"预期答案": "5", "用时": "2s"} and got[4].duplicate_group == got[5].duplicate_group != got[6].duplicate_group
    assert [tuple(x) for x in other.collect()] == [("w", 1, 2)]


def test_weeks_and_long_fractions(spark):
    r = random.Random(1)
    texts = [f"{y}-W{w:02}-{d}" for y in (1999, 2004, 2015, 2020, 2024) for w in (0, 1, 9, 52, 53, 54) for d in (0, 1, 4, 7, 8)] + ["2024-W05", "2024W05", "2024W053", "2024-W5-1", "2024-W053", "20240131"]

    def iso(t):
        try:
            return datetime.date.fromisoformat(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {x.t: x.v for x in df.select("t", normalize(F.col("t"), "date")["value"].alias("v")).collect()} == {t: iso(t) for t in texts}
    numbers = ["2.0000000000000000000001", "2." + "0" * 30, "2.5", "-3.0", "1e3", "7", "." + "0" * 25 + "1", str(r.randrange(100))]
    got = {x.t: x.v for x in spark.createDataFrame([(t,) for t in numbers], "t string").select("t", normalize(F.col("t"), "integer")["value"].alias("v")).collect()}
    assert got == dict(zip(numbers, [None, 2, None, -3, 1000, 7, None, int(numbers[-1])], strict=True))


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"a":[{"v":"x"},{"v":2},null],"b":{"c":"12"}}'), (2, '{"a":[]}'), (3, "not json"), (4, None)], "id int, text string").withColumn("p", J.parsed(F.col("text")))
    assert [tuple(x) for x in df.orderBy("id").select(J.at(F.col("p"), "$.b.c", "int"), J.length(F.col("p"), "$.a")).collect()] == [(12, 3), (None, 0), (None, 0), (None, 0)]
    got = J.opened(df, "p", "$.a", "id").select("id", "ordinal", J.at(F.col("member"), "$.v").alias("v"), J.at(F.col("member"), "$.v", "int").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "x", None), (1, 2, "2", 2), (1, 3, None, None), (2, None, None, None), (3, None, None, None), (4, None, None, None)], key=str)
    assert df.select(J.built(b=F.col("id"), a=F.lit(None).cast("string")).alias("x")).first().x == '{"a":null,"b":1}'
