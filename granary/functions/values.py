"""The six semantic types as column expressions, and the text helpers around them.

normalize(col, kind) gives STRUCT<normalizer, value, failed>: failed is set for a value that
is present and not of the kind; blank values are NULL under the normalizer "empty/v1".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted words and characters of the six types.
TRUE_WORDS = ["true", "1", "是", "有", "yes"]
FALSE_WORDS = ["false", "0", "否", "无", "no"]
ZERO_WIDTH = "​‌‍⁠﻿"
SPARK_TYPES = {"text": "string", "integer": "int", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def numeric_text(c: Column) -> Column:
    """Without zero-width characters, commas and blanks at the ends."""
    return strip(F.translate(c, ZERO_WIDTH + ",", ""))


def week_date(text: Column) -> Column:
    """The date of an ISO week: 2024-W05, 2024-W05-3, 2024W053; NULL for weeks and days that the year doesn't have."""
    form = r"^(\d{4})-W(\d{2})(?:-(\d))?$|^(\d{4})W(\d{2})(\d)?$"
    part = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(text, form, a), F.lit("")), F.nullif(F.regexp_extract(text, form, b), F.lit(""))).try_cast("int")
    year, week, day = part(1, 4), part(2, 5), F.coalesce(part(3, 6), F.lit(1))
    fourth = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("date")  # is in the first week
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    there = (week >= 1) & (day >= 1) & (day <= 7) & (F.year(F.date_add(monday, 3)) == year)  # a week is its Thursday's year's
    return F.when(text.rlike(form) & there, F.date_add(monday, day - 1))


def parse(c: Column, kind: str) -> Column:
    """The typed value of a string, NULL if it isn't one."""
    text = strip(c)
    if kind == "text":
        return text
    if kind == "boolean":
        word = F.lower(text)
        return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    if kind == "decimal":
        return numeric_text(c).try_cast("decimal(38,10)")
    if kind == "integer":
        number = numeric_text(c)
        # A wide scale, so that 2.00000000001 is not taken for 2; 1e3 and 2.0 are integers.
        odd = number.rlike(r"^[+-]?\d*\.\d*[1-9]\d*$")  # however far behind the point
        wide = F.coalesce(number.try_cast("decimal(38,18)"), number.try_cast("decimal(38,0)").cast("decimal(38,18)"))
        plain = c.rlike(r"^[+-]?[0-9]{1,9}$")  # the usual case, without decimals
        return F.when(plain, c.try_cast("int")).otherwise(F.when(~odd & (wide == F.floor(wide)), wide).try_cast("int"))
    if kind == "date":
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        flat = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date"))
        return F.coalesce(iso, flat, week_date(text))
    if kind == "datetime":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), text.try_cast("timestamp"))
    raise ValueError(f"unknown semantic type: {kind}")


def normalize(c: Column, kind: str) -> Column:
    blank = c.isNull() | (strip(c) == "")
    value = F.when(~blank, parse(c, kind))
    return F.struct(F.when(blank, "empty/v1").otherwise(f"{kind}/v1").alias("normalizer"), value.alias("value"), (~blank & value.isNull()).alias("failed"))


def spreadsheet_error(c: Column) -> Column:
    """#REF!, #N/A and the like."""
    return F.coalesce(strip(c).rlike(r"^#(NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA|SPILL!|CALC!)$"), F.lit(False))


def source_text(c: Column) -> Column:
    """Folded for comparisons of source values: no white space or punctuation, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s,，。.;；:：/\\\-—_]+", ""))


def like_any(columns: list[Column], term: str) -> Column:
    """Case-insensitive %term% over any of the columns."""
    return F.greatest(*[F.coalesce(c.ilike(f"%{term}%"), F.lit(False)) for c in columns]) if len(columns) > 1 else F.coalesce(columns[0].ilike(f"%{term}%"), F.lit(False))


def basis_points(part: Column, whole: Column) -> Column:
    """10000 * part / whole, half to even; 0 of 0 is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.bround(F.lit(10000.0) * part / whole, 0)).cast("long")


def column_letters(n: Column) -> Column:
    """1: A, 26: Z, 27: AA, up to XFD."""
    letter = lambda k: F.chr((k % 26 + 65).cast("int"))
    a, b, c = n - 1, F.floor((n - 1) / 26) - 1, F.floor((F.floor((n - 1) / 26) - 1) / 26) - 1
    return F.concat(F.when(c >= 0, letter(c)).otherwise(""), F.when(b >= 0, letter(b)).otherwise(""), letter(a))


def redact(c: Column, categories: Column | None = None) -> Column:
    """STRUCT<kind, shown> of a text: categories as they are, digits by their number, dates as they are, other text by length and hash.

    categories: an array of texts that may be shown.
    """
    # The kinds and their forms.
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    digits = F.length(F.regexp_replace(text, r"(?U)\D", ""))
    kind = F.when(text.rlike("[\u4e00-\u9fff]"), "cn_text").when(text.rlike("[A-Za-z]"), "latin_text").otherwise("text")
    known = F.lit(False) if categories is None else F.coalesce(F.array_contains(categories, text), F.lit(False))
    told = lambda k, shown: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), shown.cast("string").alias("shown"))
    masked = F.concat(F.lit("<"), F.upper(kind), F.lit(":"), F.length(text), F.lit(":"), F.substring(F.sha2(text, 256), 1, 8), F.lit(">"))
    return (
        F.when(c.isNull() | (text == ""), told("empty", F.lit(None)))
        .when(known, told("category", text))
        .when(digits >= 7, told("identifier_like", F.concat(F.lit("<DIGITS:"), digits, F.lit(">"))))
        .when(text.rlike(r"^\d{4}[-/.年]\d{1,2}([-/.月]\d{1,2}日?)?$"), told("date_like", text))
        .otherwise(told(kind, masked))
    )


# Printed labels, prompts and clauses of forms that nobody filled in.
FORM_LABELS = ["姓名", "村", "联系电话", "联系电话:", "联系电话：", "责任追究"]
FORM_MARKERS = ["签名", "本人承诺", "事由填写"]
FORM_SUFFIX = "姓名"
FORM_CLAUSE = r"^[（(]?([一二三四五六七八九十]+|\d+)[）).、]"
FORM_PERIOD = "起止时间"


def unfilled(c: Column) -> Column:
    """Whether a text is a form's own: blank, a label, a prompt or a clause. Null is not."""
    text = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    prompt = F.lit(False)
    for marker in FORM_MARKERS:
        prompt |= F.contains(text, F.lit(marker))
    period = F.contains(text, F.lit(FORM_PERIOD)) & F.contains(text, F.lit("月")) & F.contains(text, F.lit("日")) & ~text.rlike(r"\d")
    found = (text == "") | text.isin(FORM_LABELS) | ((F.length(text) <= 12) & F.endswith(text, F.lit(FORM_SUFFIX))) | text.rlike(FORM_CLAUSE) | prompt | period
    return F.coalesce(found, F.lit(False))


def file_key(c: Column) -> Column:
    """A file's name without folder, suffix, white space and case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)$", 1), r"\.[A-Za-z0-9]{1,5}$", ""), r"(?U)\s+", ""))
