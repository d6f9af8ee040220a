"""The six types and the text helpers."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from granary.functions import values as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("text", "　 a b\t", "a b"),
        ("integer", "1,200", 1200),
        ("integer", "2.0", 2),
        ("integer", "1e3", 1000),
        ("integer", "2.00000000001", None),
        ("integer", "3000000000", None),
        ("integer", "​12", 12),
        ("decimal", "22.75068493150685", Decimal("22.7506849315")),
        ("decimal", "1.00000000005", Decimal("1.0000000001")),
        ("decimal", "-1.00000000005", Decimal("-1.0000000001")),
        ("decimal", "NaN", None),
        ("boolean", "是", True),
        ("boolean", "NO", False),
        ("boolean", "maybe", None),
        ("date", "2026-01-02", datetime.date(2026, 1, 2)),
        ("date", "20260102", datetime.date(2026, 1, 2)),
        ("date", "2026-1-2", None),
        ("date", "2026-01-02 10:00", None),
        ("datetime", "2026-01-02 10:00:00", datetime.datetime(2026, 1, 2, 10)),
    ],
)
def test_normalize(spark, kind, text, want):
    got = one(spark, text, lambda c: V.normalize(c, kind))
    assert got.value == want and got.failed == (want is None) and got.normalizer == f"{kind}/v1"


def test_blank_is_null_and_not_failed(spark):
    for blank in (None, "", "  "):
        got = one(spark, blank, lambda c: V.normalize(c, "decimal"))
        assert got.normalizer == "empty/v1" and got.value is None and not got.failed


def test_helpers(spark):
    assert one(spark, "#N/A", V.spreadsheet_error) and not one(spark, "N/A", V.spreadsheet_error)
    assert one(spark, "重庆市 巴南区-青禾组，180号", V.source_text) == "重庆市巴南区青禾组180号"
    assert one(spark, "/a/b/ My File.XLSX", V.file_key) == "myfile"
    assert [spark.range(1).select(V.column_letters(F.lit(n)).alias("a")).first().a for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert [spark.range(1).select(V.basis_points(F.lit(a), F.lit(b)).alias("a")).first().a for a, b in ((1, 20000), (3, 20000), (0, 0), (1, 3))] == [0, 2, 0, 3333]
