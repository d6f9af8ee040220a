"""Household lookups and lookups by source text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import source_text
from ..operators.select import filtered, projected, scoped, visible
from .contracts import FactSet, Filter, QueryError, Scope

HEAD = "户主"  # fixed value: the relation that marks the head of a household


def household(facts: FactSet, scope: Scope, by: str, value: str, what: str, number: str, person: str, relation: str, select: tuple[str, ...]) -> DataFrame:
    """The head or all members of the households that a household number or a person's name leads to.

    A person's name first leads to household numbers, then to the rows that share them.
    """
    if by not in {"household_number", "person_name"} or what not in {"head", "members"}:
        raise QueryError("unknown household question")
    df = scoped(facts, scope)
    if by == "household_number":
        rows = df.filter(facts.value(number) == value)
    else:
        keys = df.filter(facts.value(person) == value).select(facts.value(number).alias("_number")).filter("_number is not null").distinct()
        rows = df.join(keys, facts.value(number) == F.col("_number"), "left_semi")
    if what == "head":
        rows = rows.filter(facts.value(relation) == HEAD)
    return projected(rows.dropDuplicates(["record_id"]), facts, select)


def households(sets: Sequence[tuple[FactSet, str, str, str, tuple[str, ...]]], scope: Scope, by: str, value: str, what: str) -> DataFrame:
    """household() over several fact sets: (facts, number, person, relation, select) each.

    Columns that a fact set doesn't show are null. Of rows with one record_id that of the last
    fact set counts.
    """
    found = [household(facts, scope, by, value, what, number, person, relation, select).withColumn("_turn", F.lit(i)) for i, (facts, number, person, relation, select) in enumerate(sets)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    last = Window.partitionBy("record_id").orderBy(F.col("_turn").desc())
    return rows.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place", "_turn")


def source_fields(raw: DataFrame, scope: Scope) -> DataFrame:
    """Distinct headers of each file and sheet in scope. raw: record columns, item_id, sheet_id, columns (map of id to struct of header_path, value)."""
    path = F.array_join(F.col("column.header_path"), " / ")
    headers = visible(raw, scope).select("item_id", "sheet_id", F.explode(F.map_values("columns")).alias("column"))
    return headers.groupBy("item_id", "sheet_id").agg(F.array_sort(F.collect_set(path)).alias("headers"))


def source_rows(raw: DataFrame, scope: Scope, terms: list[str], filters: list[tuple[str, str, str]], facts: FactSet | None = None, semantic: Sequence[Filter] = (), limit: int | None = None) -> DataFrame:
    """Rows in scope whose source columns satisfy all filters, with the values of columns that a header term names.

    semantic: filters on the fields of facts, for the same record_id. limit: at most so many
    rows, from 1 to 100, in order of record_id. filters: (header term, eq or contains, value). A value matches one column of the term or the
    joined text of all of them, after white space, punctuation and case are folded.
    """
    if len(terms) > 20 or len(filters) > 4 or len(semantic) > 4:
        raise QueryError("at most 20 header terms, 4 source filters and 4 field filters")
    if semantic and facts is None:
        raise QueryError("field filters need a fact set")
    if limit is not None and not 1 <= limit <= 100:
        raise QueryError("limit must be from 1 to 100")
    raw = visible(raw, scope)
    if semantic:
        raw = raw.join(filtered(scoped(facts, scope), facts, semantic).select("record_id"), "record_id", "left_semi")
    entries = F.map_values("columns")
    path = lambda c: F.lower(F.array_join(c["header_path"], " / "))
    def matches(term: str, op: str, value: str) -> Column:
        named = F.filter(entries, lambda c: F.contains(path(c), F.lit(term.lower())))
        texts = F.transform(named, lambda c: source_text(F.coalesce(c["value"], F.lit(""))))
        wanted = source_text(F.lit(value))
        hit = (lambda x: x == wanted) if op == "eq" else (lambda x: F.contains(x, wanted))
        return F.exists(texts, hit) | hit(F.array_join(texts, ""))

    for f in filters:
        raw = raw.filter(matches(*f))
    shown = F.filter(entries, lambda c: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(path(c), t))) if terms else F.array().cast(raw.select(entries).schema[0].dataType)
    found = raw.withColumn("shown", shown)
    return found if limit is None else found.orderBy("record_id").limit(limit)
