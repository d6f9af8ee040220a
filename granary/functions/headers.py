"""What a column's header says: role, concept, base label and qualifier, as column expressions.

A header path is an array of strings, from the outermost heading to the leaf. Only Unicode's
compatibility form needs Python; it runs as a Pandas UDF over headers, of which there are few.
Case folding is lower case, with the sharp s as two letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Who a column is about, and the words for it.
ROLES = {
    "household_head": ["户主", "户主本人"],
    "applicant": ["申请人", "申报人"],
    "beneficiary": ["受益人", "享受人", "补贴对象", "救助对象"],
    "guardian": ["监护人", "监护照料人"],
    "spouse": ["配偶", "妻子", "丈夫"],
    "father": ["父亲", "父"],
    "mother": ["母亲", "母"],
    "child": ["子女", "儿子", "女儿"],
    "contact": ["联系人"],
    "responsible_person": ["负责人", "责任人"],
    "account_holder": ["开户人", "持卡人", "账户名"],
    "payer": ["缴费人", "付款人"],
    "member": ["家庭成员", "成员"],
    "subject": ["本人"],
    "male_party": ["男方", "夫方"],
    "female_party": ["女方", "妻方"],
}
# What a column holds; of each concept its label and the words for it.
CONCEPTS = {
    "person.name": ["姓名", "人员姓名", "个人姓名", "村民姓名", "农户姓名", "居民姓名", "成员姓名", "名字"],
    "person.identity_number": ["身份证号", "身份证号码", "公民身份号码", "居民身份证号码", "证件号码"],
    "person.phone": ["联系电话", "联系方式", "电话", "手机号", "手机号码", "电话号码"],
    "person.gender": ["性别"],
    "person.birth_date": ["出生日期", "出生年月", "出生时间"],
    "person.address": ["家庭地址", "家庭住址", "居住地址", "现住址"],
    "finance.bank_account": ["银行账号", "银行账户", "银行卡号", "一卡通账号"],
    "household.member_count": ["家庭人口", "家庭人口数", "家庭成员数", "家庭总人口", "人数（人）", "人数(人)"],
    "household.relationship_to_head": ["与户主关系", "与户主关系（与派出所人口比对）", "与户主关系(与派出所人口比对)"],
    "governance.issue_location": ["问题属地", "事发村组"],
    "governance.dispute_type": ["矛盾纠纷类别", "纠纷类别"],
}
# Labels that say nothing without their context, and the marks of titles and of values.
AMBIGUOUS = ["名称", "编号", "编码", "类型", "类别", "状态", "日期", "时间", "金额", "数量", "面积", "地址", "备注", "是否"]
TITLES = ["明细", "台账", "清册", "汇总", "统计", "登记表", "信息表", "花名册"]
VALUE_TITLES = ["台账", "清册", "名册", "花名册", "汇总表", "统计表", "登记表"]
PATH_TITLES = ["表", "名册", "台账", "登记", "汇总", "清册"]
FIELD_MARKS = [
    "姓名", "名称", "编号", "编码", "号码", "身份证", "电话", "联系", "地址", "住址", "性别", "年龄", "民族", "日期", "时间", "金额", "数量", "面积", "类型", "类别", "状态", "备注", "关系",
    "户主", "家庭", "人口", "账号", "账户", "银行", "单位", "人员", "序号", "学历", "文化程度", "是否", "原因", "情况", "归属", "所在", "所属",
]
SHORT_FIELDS = ["乡", "镇", "村", "组", "户", "社区", "乡镇", "村组", "组别", "行政村", "自然村", "乡镇街道", "街道乡镇", "镇、街道", "村、社区", "村或社区"]
VALUES = ["男", "女", "是", "否", "无", "有", "至今", "本人"]
VALUE_ENDS = ["有限公司", "合作社", "支行", "酒店", "服务中心", "卫生院", "环卫站", "村民委员会", "居民委员会"]
PLACE_ENDS = ["村", "社区", "街道", "乡", "镇"]
UNIT = r"[（(][^（）()]{1,20}(?:元|亩|人|户|个|年|月|日|%|％)[）)]$"
OTHER_ROLES = {"head": "household_head", "householdhead": "household_head", "primarycontact": "contact", "duplicate": "duplicate", "registrycomparison": "registry_comparison"}


def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(_nfkc)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_parts(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else [_nfkc(x) for x in p])


def folded(c: Column) -> Column:
    """Letters and digits only, in lower case, of a text in compatibility form."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def label_key(c: Column) -> Column:
    return folded(nfkc(c))


def _key(word: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", word).casefold() if x.isalnum())


def spaced(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def let(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), in which c is computed once, however often of uses it."""
    return F.transform(F.array(c), of)[0]


def _any(c: Column, words: list[str], how: str) -> Column:
    """Whether c contains, or ends with, one of the words."""
    test = (lambda x: F.contains(c, x)) if how == "contains" else (lambda x: F.endswith(c, x))
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), test), F.lit(False))


def is_value(part: Column, key: Column) -> Column:
    """Whether a header is an observed value rather than a field's label. part: spaced; key: its label_key."""
    label = part.isin(SHORT_FIELDS) | _any(part, FIELD_MARKS, "contains") | part.rlike(r"^(?:1[0-2]|[1-9])月$")
    digits = part.rlike(r"^[\d\s./:：年月日\-—至]+$") & part.rlike(r"\d")
    value = digits | key.rlike(r"^\d{6,}[0-9x]?$") | part.isin(VALUES) | _any(part, VALUE_ENDS, "endswith") | (_any(part, VALUE_TITLES, "contains") & (F.length(key) >= 8))
    value |= part.rlike(r"\d{6,}") | (part.contains("/") & part.rlike(r"\d")) | ((F.length(key) > 2) & _any(part, PLACE_ENDS, "endswith"))
    return F.when(key == "", True).when(label, False).otherwise(value)


def semantic_parts(path: Column) -> Column:
    """Array of struct<part, form, key> of the path without observed values; empty if the leaf is one.

    form: the part in Unicode's compatibility form; key: its label_key.
    """
    plain = F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda p: spaced(F.coalesce(p, F.lit(""))))
    parts = F.filter(F.zip_with(plain, nfkc_parts(plain), lambda p, n: F.struct(p.alias("part"), n.alias("form"), folded(n).alias("key"))), lambda x: x["part"] != "")
    judged = F.transform(parts, lambda x: F.struct(x.alias("x"), is_value(x["part"], x["key"]).alias("value")))

    def of(judged: Column) -> Column:
        labels = F.transform(F.filter(judged, lambda y: ~y["value"] & ~F.coalesce(F.try_element_at(judged, F.lit(-1))["value"], F.lit(True))), lambda y: y["x"])
        return labels

    return let(judged, of)


def semantic_path(path: Column) -> Column:
    """The path without observed values; empty if the leaf is one."""
    return F.transform(semantic_parts(path), lambda x: x["part"])


def role_in(key: Column) -> Column:
    """struct<n, role, alias> of the longest word for a role in a label key, NULL without any."""
    words = F.array(*[F.struct(F.lit(len(_key(w))).alias("n"), F.lit(role).alias("role"), F.lit(w).alias("alias"), F.lit(_key(w)).alias("key")) for role, said in ROLES.items() for w in said])
    return F.array_max(F.filter(words, lambda w: F.contains(key, w["key"])))


def _table(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), F.coalesce(key, F.lit("")))


def concept_of(key: Column) -> Column:
    """The concept that a label key names, or NULL."""
    return _table({_key(w): concept for concept, words in CONCEPTS.items() for w in words}, key)


def concept_label(concept: Column) -> Column:
    return _table({concept: words[0] for concept, words in CONCEPTS.items()}, concept)


def header_semantics(path: Column) -> Column:
    """See semantics_of."""
    return semantics_of(nfkc_parts(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))))


def semantics_of(forms: Column) -> Column:
    """struct<leaf, base_label, base_key, concept, role, role_evidence, qualifier> of a header path in compatibility form.

    A role in the leaf counts if what is left of the leaf names a concept; else the nearest
    heading above with a role gives it. An ambiguous label is qualified by the nearest short
    heading that is neither a title nor numbered.
    """
    compact = F.transform(forms, lambda p: F.trim(F.regexp_replace(spaced(p), UNIT, "")))
    parts = F.transform(F.filter(compact, lambda p: p != ""), lambda p: let(folded(p), lambda k: F.struct(p.alias("part"), k.alias("key"), role_in(k).alias("named"))))

    def without_role(parts: Column) -> Column:
        leaf = F.try_element_at(parts, F.lit(-1))
        part, alias = F.coalesce(leaf["part"], F.lit("")), leaf["named"]["alias"]
        cut = let(F.instr(part, alias), lambda at: F.when(at > 0, F.btrim(F.concat(F.substring(part, F.lit(1), at - 1), F.substring(part, at + F.length(alias), F.length(part))), F.lit(" -_/·:："))))
        rest = let(cut, lambda c: F.when(c != "", c).otherwise(part))
        above = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
        return F.struct(part.alias("leaf"), F.coalesce(leaf["key"], F.lit("")).alias("key"), leaf["named"]["role"].alias("role"), rest.alias("rest"), folded(rest).alias("rest_key"), above.alias("above"))

    def by_leaf(x: Column) -> Column:
        person = (x["role"].isin("household_head", "mother", "father") & x["rest_key"].isin("实际", "未成年人")) | (x["role"].isin("guardian", "contact") & _any(x["leaf"], ["监护照料人", "联系人"], "endswith"))
        account_name, account_id = x["key"] == "账户姓名", x["key"].endswith("账户身份证号")
        found = F.when(account_id, "person.identity_number").when(account_name | F.coalesce(person, F.lit(False)), "person.name").otherwise(concept_of(x["rest_key"]))
        role = F.when(account_name | account_id, "account_holder").otherwise(x["role"])
        return F.struct(x.alias("x"), found.alias("concept"), role.alias("role"), (found.isNotNull() & role.isNotNull()).alias("own"), concept_of(x["key"]).alias("whole"))

    def told(y: Column) -> Column:
        x = y["x"]
        several = lambda p: (p.contains("联系人") & p.contains("联系电话")) | (F.length(F.regexp_replace(p, "[^：:]", "")) > 1)
        holder = F.try_element_at(F.filter(x["above"], lambda p: ~several(p["part"]) & p["named"].isNotNull()), F.lit(1))
        holder = F.when(y["concept"].isNotNull() & ~y["own"], holder)
        base = F.when(y["own"], F.coalesce(concept_label(y["concept"]), x["rest"])).otherwise(F.coalesce(concept_label(y["whole"]), x["leaf"]))
        fine = F.filter(x["above"], lambda p: (p["key"] != "") & ~p["key"].rlike(r"\d") & (F.length(p["key"]) <= 16) & ~_any(p["part"], TITLES, "contains"))
        return F.struct(
            x["leaf"].alias("leaf"), base.alias("base_label"), folded(base).alias("base_key"), F.when(y["own"], y["concept"]).otherwise(y["whole"]).alias("concept"),
            F.when(y["own"], y["role"]).otherwise(holder["named"]["role"]).alias("role"), F.when(y["own"], x["leaf"]).otherwise(holder["part"]).alias("role_evidence"),
            F.when(base.isin(AMBIGUOUS), F.try_element_at(fine, F.lit(1))["part"]).alias("qualifier"),
        )

    return let(let(let(parts, without_role), by_leaf), told)


def semantic_identity(semantics: Column, domain: Column, data_type: Column, unit: Column) -> Column:
    """struct<concept, domain, qualifier, data_type, unit> that two columns of one meaning share."""
    known = semantics["concept"].isNotNull()
    return F.struct(
        F.when(known, semantics["concept"]).otherwise(semantics["base_key"]).alias("concept"),
        F.when(~known & semantics["base_label"].isin(AMBIGUOUS), domain).alias("domain"),
        F.when(~known, folded(semantics["qualifier"])).alias("qualifier"), data_type.alias("data_type"), unit.alias("unit"),
    )


def same_meaning(a: Column, b: Column) -> Column:
    """Whether the header semantics a and b name one field: the concept if a has one, else the base label."""
    return F.when(a["concept"].isNotNull(), a["concept"].eqNullSafe(b["concept"])).otherwise(a["base_key"] == b["base_key"])


def equivalent_labels(label: Column) -> Column:
    """The keys of all labels that mean the same: its own, its base label's and its concept's."""
    known = {c: " ".join(sorted({_key(w) for w in words})) for c, words in CONCEPTS.items()}

    def of(s: Column) -> Column:
        more = F.coalesce(F.split(_table(known, s["concept"]), " "), F.array().cast("array<string>"))
        return F.concat(F.array(s["base_key"]), more)

    all_ = F.concat(F.array(label_key(label)), let(header_semantics(F.array(label)), of))
    return F.array_sort(F.array_distinct(F.filter(all_, lambda x: x != "")))


def _spaced_parts(path: Column) -> Column:
    return F.filter(F.transform(path, spaced), lambda p: p != "")


def paths_equivalent(a: Column, b: Column) -> Column:
    """Whether two paths are equal, or are so without the title of the document above."""

    def untitled(p: Column) -> Column:
        titled = (F.size(p) >= 2) & _any(F.try_element_at(p, F.lit(1)), [*PATH_TITLES, "统计"], "contains")
        return F.when(titled, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        short, long = F.when(F.size(a) < F.size(b), a).otherwise(b), F.when(F.size(a) < F.size(b), b).otherwise(a)
        more = F.size(long) - F.size(short)
        below = (F.size(short) > 0) & (F.slice(long, more + 1, F.size(short)) == short)
        titled = _any(F.array_join(F.slice(long, F.lit(1), more), " "), PATH_TITLES, "contains")
        return (a == b) | ((F.size(untitled(a)) > 0) & (untitled(a) == untitled(b))) | (below & titled)

    return let(F.struct(_spaced_parts(a).alias("a"), _spaced_parts(b).alias("b")), of)


def role_code(c: Column) -> Column:
    """The code of a role from a code, a word for it or a numbered or dated variant; NULL if it is none."""
    known = {_key(role): role for role in ROLES} | {_key(w): role for role, words in ROLES.items() for w in words} | OTHER_ROLES

    def of(key: Column) -> Column:
        numbered = F.when(key.rlike(r"^duplicate\d+$"), F.concat(F.lit("duplicate_"), F.substring(key, 10, 99)))
        dated = F.when(key.rlike(r"^(?:date|asof)\d{8}$"), F.regexp_replace(key, r"^(?:date|asof)(\d{4})(\d{2})(\d{2})$", "date_$1_$2_$3"))
        return F.coalesce(_table(known, key), numbered, dated)

    return let(label_key(c), of)


def header_set(paths: Column) -> Column:
    """Distinct labels "a / b" of paths, without the title that all of them begin with."""

    def depth(paths: Column) -> Column:
        first = F.try_element_at(paths, F.lit(1))
        agree = F.transform(first, lambda x, i: F.forall(paths, lambda p: F.coalesce(F.try_element_at(p, i + 1) == x, F.lit(False))))
        common = F.when((F.size(paths) > 0) & F.forall(paths, lambda p: F.size(p) > 1), F.array_position(F.concat(agree, F.array(F.lit(False))), F.lit(False)).cast("int") - 1).otherwise(0)
        return F.struct(paths.alias("paths"), common.alias("n"), F.array_join(F.slice(F.coalesce(first, F.array().cast("array<string>")), F.lit(1), common), " ").alias("title"))

    def of(x: Column) -> Column:
        drop = F.when((x["n"] > 0) & _any(x["title"], PATH_TITLES, "contains"), x["n"]).otherwise(0)
        left = F.transform(x["paths"], lambda p: F.slice(p, drop + 1, F.greatest(F.size(p) - drop, F.lit(0))))
        return F.array_distinct(F.transform(F.filter(left, lambda p: F.size(p) > 0), lambda p: F.array_join(p, " / ")))

    kept = F.filter(F.transform(F.coalesce(paths, F.array().cast("array<array<string>>")), _spaced_parts), lambda p: F.size(p) > 0)
    return let(let(kept, depth), of)
