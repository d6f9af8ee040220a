"""Predicates and projections over wide fact sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import SPARK_TYPES, parse
from ..plans.contracts import OPS, FactSet, Filter, QueryError, Scope, name


def visible(df: DataFrame, scope: Scope) -> DataFrame:
    """The rows of a table with record columns that a scope shows."""
    df = df.filter(scope.predicate())
    return df if scope.frozen is None else df.join(scope.frozen, "item_id", "left_semi")


def scoped(facts: FactSet, scope: Scope) -> DataFrame:
    """The fact set's records that a scope shows; tenant, type and provenance prune a store's partitions."""
    return visible(facts.df.filter(facts.predicate()), scope)


def operand(facts: FactSet, code: str, value) -> Column:
    """A literal, normalized to the field's type; a blank is NULL."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return F.lit(None).cast(SPARK_TYPES[facts.types[code]])
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return parse(F.lit(text), facts.types[code])


def condition(facts: FactSet, f: Filter, escape: bool = False) -> Column:
    """A field filter. It holds only for records that have the field.

    contains is LIKE '%value%', in which % and _ of the value are wild unless escape is set.
    eq with a blank finds fields that are there without a value.
    """
    if f.op not in OPS:
        raise QueryError(f"unknown operator: {f.op}")
    here, kind = facts.value(f.code), facts.types[f.code]
    there = facts.present(f.code)
    if f.op == "in":
        if not isinstance(f.value, (list, tuple)):
            raise QueryError("in needs a list")
        return there & (here.isin([operand(facts, f.code, v) for v in f.value]) if f.value else F.lit(False))
    if isinstance(f.value, (list, tuple)):
        raise QueryError(f"{f.op} takes one value")
    blank = f.value is None or (isinstance(f.value, str) and not f.value.strip())
    if f.op == "eq":
        return there & here.isNull() if blank else here == operand(facts, f.code, f.value)
    if f.op == "contains":
        if kind != "text":
            raise QueryError("contains needs a text field")
        text = str(f.value)
        if escape:
            text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return here.like(f"%{text}%")
    if blank or isinstance(f.value, bool):
        raise QueryError(f"{f.op} needs a value with an order")
    x = operand(facts, f.code, f.value)
    return {"gt": here > x, "gte": here >= x, "lt": here < x, "lte": here <= x}[f.op]


def filtered(df: DataFrame, facts: FactSet, filters: Iterable[Filter], escape: bool = False) -> DataFrame:
    for f in filters:
        df = df.filter(condition(facts, f, escape))
    return df


def projected(df: DataFrame, facts: FactSet, codes: Sequence[str]) -> DataFrame:
    """record_id, item_id and the values under the codes' last parts."""
    return df.select("record_id", "item_id", *[facts.value(c).alias(c.rpartition(".")[2]) for c in codes])


def long_values(facts: FactSet, df: DataFrame, codes: Iterable[str] | None = None, more: Sequence[str] = (), apart: bool = False) -> DataFrame:
    """The value rows of a wide fact set: record_id, field_code, field_version, role, data_type and a column for each type.

    codes: only these fields are unrolled; more: further columns of df that come along. apart makes each field a
    select of its own: a condition on field_code then leaves only the fields it names, and the scan reads nothing else;
    without one the records are read once for each field, of which each reads its own columns.
    """
    rows = []
    for code in facts.types if codes is None else codes:
        kind = facts.types[code]
        for role in ("", *facts.roles.get(code, ())):
            cell = F.col(f"`{name(code, role)}`")
            typed = [(cell["v"] if k == kind else F.lit(None)).cast(t).alias(f"{k}_value") for k, t in SPARK_TYPES.items()]
            known = [F.lit(code).alias("field_code"), F.lit(facts.field_versions.get(code, 1)).alias("field_version"), F.lit(role).alias("role"), F.lit(kind).alias("data_type")]
            rows.append((cell["present"], [*known, *typed]))
    own = ["record_id", "item_id", "unit_id", *more]
    if apart and rows:
        parts = [df.filter(present).select(*own, *columns) for present, columns in rows]
        return reduce(DataFrame.unionByName, parts)
    each = F.inline(F.array(*[F.struct(*columns, F.coalesce(present, F.lit(False)).alias("present")) for present, columns in rows]))
    return df.select(*own, each).filter("present").drop("present")
