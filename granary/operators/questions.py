"""Classification of questions by what the published data can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fields import parts
from .listing import fill_down_within

# Words that decide a question's class.
SENSITIVE = ["身份证", "身份证号", "公民身份号码", "手机号", "电话号码", "银行卡", "银行账号", "一卡通号", "社保卡号", "残疾证号", "对公账户", "户编号", "手机"]
UNRESOLVED = ["这个人", "该人员", "上述人员", "此人", "该户"]
RELATIONS = ["亲属关系", "家庭成员关系", "户主与", "同一人", "重复人员", "跨表", "同比", "环比", "增长率", "变化趋势", "历年"]
REFUSED = ["预测", "推测", "猜测", "为什么会", "应该如何"]
ASKING = ["多少", "总数", "数量", "几人", "几户", "名单", "哪些", "最高", "最低", "分别", "各村"]
NUMERIC = ["总金额", "合计金额", "金额共", "总收入", "合计收入", "平均", "均值"]
LEAST_KEY = 4  #: characters of a file key that may match a part of another


def _has(c: Column, words: list[str]) -> Column:
    return F.coalesce(F.greatest(*[c.contains(w) for w in words]), F.lit(False))


def matching_sources(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """case_id, source_key: a case's file keys (reference_keys) and the sources' that contain them or lie in them."""
    asked = cases.select("case_id", F.explode("reference_keys").alias("ref")).filter("ref <> ''").distinct()
    known = sources.select("source_key").filter("source_key <> ''").distinct()
    inner = asked.select("case_id", F.explode(parts(F.col("ref"), LEAST_KEY)).alias("source_key")).join(known, "source_key").select("case_id", "source_key")
    outer = known.select("source_key", F.explode(parts(F.col("source_key"), LEAST_KEY)).alias("ref")).join(asked, "ref").select("case_id", "source_key")
    return inner.union(outer).distinct()


def classify(cases: DataFrame, terms: DataFrame, fields: DataFrame, enforce_sensitive: bool = False) -> DataFrame:
    """cases: case_id, question, reference_keys; terms: code, term, data_type; fields: source_key, code, queryable, fact_set_key.

    One row per case: case_id, category, reason, reference (matched, unmatched, not_specified), codes. Rules apply in order.
    """
    q = F.col("question")
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 2
    matched = cases.select("case_id", F.explode(parts(q, 2, longest)).alias("term")).join(terms.filter("length(term) >= 2").select("code", "term", "data_type"), "term")
    codes = matched.groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max(F.col("data_type").isin("integer", "decimal")).alias("typed"))
    sources = matching_sources(cases, fields)
    of_source = sources.join(fields, "source_key")
    reached = of_source.groupBy("case_id").agg(F.collect_set("code").alias("held"), F.collect_set(F.when(F.col("queryable"), F.col("code"))).alias("open"), F.countDistinct("fact_set_key").alias("n_sets"))
    # Questions that name no file are held against all fields: by code, not by a list of them.
    anywhere = fields.groupBy("code").agg(F.max("queryable").alias("queryable"))
    found = matched.select("case_id", "code").distinct().join(anywhere, "code").groupBy("case_id").agg(F.lit(True).alias("any_held"), F.coalesce(F.bool_or("queryable"), F.lit(False)).alias("any_open"))
    named = F.size(F.filter("reference_keys", lambda k: k != "")) > 0
    full = cases.join(codes, "case_id", "left").join(reached, "case_id", "left").join(found, "case_id", "left")
    empty = F.array().cast("array<string>")
    full = full.withColumn("codes", F.coalesce("codes", empty)).withColumn("n_sets", F.when(named, F.coalesce("n_sets", F.lit(0))).otherwise(0))
    holds = F.when(named, F.arrays_overlap("codes", F.coalesce("held", empty))).otherwise(F.coalesce("any_held", F.lit(False)))
    opens = F.when(named, F.arrays_overlap("codes", F.coalesce("open", empty))).otherwise(F.coalesce("any_open", F.lit(False)))
    reference = F.when(~named, "not_specified").when(F.col("held").isNotNull(), "matched").otherwise("unmatched")
    any_code = F.size("codes") > 0
    rules = [
        (F.lit(enforce_sensitive) & _has(q, SENSITIVE), "sensitive_permission_blocked", "contains_direct_sensitive_identifier"),
        (_has(q, UNRESOLVED), "should_clarify", "standalone_question_has_unresolved_reference"),
        (_has(q, REFUSED), "should_refuse", "requests_prediction_or_causal_judgement"),
        (reference == "unmatched", "data_not_ingested", "referenced_file_not_found_in_approved_records"),
        (_has(q, RELATIONS), "semantic_assessment_required", "requires_unpublished_relation_or_time_contract"),
        (_has(q, NUMERIC) & any_code & ~F.coalesce("typed", F.lit(False)), "semantic_assessment_required", "numeric_measure_is_not_typed"),
        (any_code & opens & _has(q, ASKING), "governed_executable", "published_contract_and_queryable_field_present"),
        (holds & _has(q, ASKING) & (F.col("n_sets") == 1), "bounded_query_candidate", "single_fact_set_and_approved_field_present"),
        (holds & (F.col("n_sets") != 1), "should_clarify", "bounded_query_fact_set_is_not_unique"),
        (any_code, "semantic_assessment_required", "matching_field_is_not_present_in_referenced_data"),
    ]
    found = F.struct(F.lit("semantic_assessment_required").alias("category"), F.lit("no_queryable_approved_field_match").alias("reason"))
    for when, category, reason in reversed(rules):
        found = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(category).alias("category"), F.lit(reason).alias("reason"))).otherwise(found)
    return full.select("case_id", found.alias("f"), reference.alias("reference"), "codes").select("case_id", "f.category", "f.reason", "reference", "codes")


# The headers of a workbook of questions, in how many of a sheet's first rows they stand, and what earlier answers' headers hold.
QUESTION, VILLAGE, REFERENCE = "提问", "所属村委", "参考表格"
HEADER_ROWS = 10
EARLIER, EARLIER_EXACT = "预期|符合", ["用时", "问答用时"]


def read_questions(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions of workbooks, and the sheets without any.

    cells: workbook_id, sheet, sheet_name, row, col, value. The first has workbook_id, sheet, sheet_name, row, question, village, reference, earlier (map of header to
    value), duplicate_group; the village stands for the rows below, the reference file until the next village. The second has workbook_id,
    sheet, excluded: the filled cells of column B below a sheet's first row. The header is the first of a sheet's first ten filled rows that
    says so; of several columns with one header the first counts, of earlier answers the last.
    """
    key = ["workbook_id", "sheet"]
    there = cells.withColumn("value", F.trim("value")).filter("value <> ''")
    rows = there.select(*key, "row").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("row")))
    head = there.join(rows.filter(F.col("place") <= HEADER_ROWS).select(*key, "row"), [*key, "row"])
    at = head.filter(F.col("value") == QUESTION).groupBy(*key).agg(F.min("row").alias("head"))
    alike = Window.partitionBy(*key, "value")
    headers = head.join(at, key).filter("row = head").withColumns({"place": F.row_number().over(alike.orderBy("col")), "back": F.row_number().over(alike.orderBy(F.col("col").desc()))})
    kind = F.when(F.col("place") == 1, F.when(F.col("value") == QUESTION, "question").when(F.col("value") == VILLAGE, "village").when(F.col("value") == REFERENCE, "reference"))
    kind = F.coalesce(kind, F.when((F.col("back") == 1) & (F.col("value").rlike(EARLIER) | F.col("value").isin(EARLIER_EXACT)), "earlier"))
    headers = headers.select(*key, "col", F.col("value").alias("header"), kind.alias("kind"), "head").filter("kind is not null")
    below = there.join(headers, [*key, "col"]).filter("row > head")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    earlier = F.map_from_entries(F.array_distinct(F.collect_list(F.when(F.col("kind") == "earlier", F.struct("header", "value"))))).alias("earlier")
    wide = below.groupBy(*key, "sheet_name", "row").agg(one("question"), one("village"), one("reference"), earlier)
    filled = fill_down_within(wide, "village", "reference", key, [F.col("row")], ("in_village", "in_reference")).filter("question is not null")
    normal = F.regexp_replace("question", r"(?U)\s+", "")
    group = F.concat(F.lit("duplicate-"), F.substring(F.sha2(normal, 256), 1, 20))
    questions = filled.select(*key, "sheet_name", "row", "question", F.coalesce("in_village", F.lit("")).alias("village"), F.coalesce("in_reference", F.lit("")).alias("reference"), "earlier", group.alias("duplicate_group"))
    other = there.join(at, key, "left_anti").join(rows, [*key, "row"]).groupBy(*key).agg(F.count(F.when((F.col("place") > 1) & (F.col("col") == 2), 1)).alias("excluded"))
    return questions, other
