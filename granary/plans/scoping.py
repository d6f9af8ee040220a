"""Frozen scopes, and the catalog of what a frozen scope holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import evidence_columns
from ..operators.select import visible
from .contracts import ORIGIN, FactSet, Scope

MOST_FACT_SETS, MOST_FIELDS = 40, 160


@dataclass(frozen=True)
class Frozen:
    scope: Scope
    items: DataFrame  # item_id
    superseded: DataFrame  # item_id
    fingerprint: str


def role_scope(df: DataFrame, role: str, tenant_id: str, units: Sequence[str] = (), by_unit: bool = False) -> DataFrame:
    """The records that a role may list: all, its tenant's, or those of its tenant's units.

    role: platform_admin sees all and tenant_admin its tenant; any other sees its tenant, or with
    by_unit only the units named.
    """
    if role == "platform_admin":
        return df
    own = df.filter(F.col("tenant_id") == tenant_id)
    return own.filter(F.col("unit_id").isin(list(units))) if by_unit and role != "tenant_admin" else own


def freeze(records: DataFrame, tenant_id: str, units: Sequence[str], before: Any, replaced: DataFrame | None = None, selected: str | None = None) -> Frozen:
    """The approved items that a question may see, fixed in one job.

    records: a table with record columns; replaced: old_id, new_id, declared_at. Items with passed
    records up to `before` are eligible. An eligible item goes if a declaration up to `before`
    replaces it by an eligible one, unless it is selected; an item that isn't eligible can't
    be. The items stay a table; what reaches the driver is their fingerprint, the SHA-256 of
    the sorted ids in lines.
    """
    open_ = Scope(tenant_id, tuple(units), before=before)
    eligible = records.filter(open_.predicate()).select("item_id").distinct()
    gone = eligible.limit(0)
    if replaced is not None:
        declared = replaced.filter(F.col("declared_at") <= F.lit(before).cast("timestamp"))
        new = declared.join(eligible.withColumnRenamed("item_id", "new_id"), "new_id", "left_semi")
        gone = eligible.join(new.select(F.col("old_id").alias("item_id")), "item_id", "left_semi")
    items = eligible.filter(F.col("item_id") == selected) if selected is not None else eligible.join(gone, "item_id", "left_anti")
    items = items.checkpoint() if records.sparkSession.sparkContext.getCheckpointDir() else items.cache()
    return Frozen(Scope(tenant_id, tuple(units), before=before, frozen=items), items, gone, fingerprint_of(items))


def fingerprint_of(items: DataFrame) -> str:
    """The SHA-256 of the sorted item_ids, distinct, in lines.

    Tasks sort ranges of ids and join them; one then reads the pieces in order and holds one at a time.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            if len(ids):
                yield pd.DataFrame({"first": [ids["item_id"].iloc[0]], "lines": ["\n".join(ids["item_id"])]})

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, some = hashlib.sha256(), False
        for pieces in batches:
            for lines in pieces["lines"]:
                state.update((b"\n" if some else b"") + lines.encode())
                some = True
        yield pd.DataFrame({"digest": [state.hexdigest()]})

    ids = items.select(F.col("item_id").cast("string")).dropna()
    pieces = ids.repartitionByRange("item_id").sortWithinPartitions("item_id").mapInPandas(joined, "first string, lines string")
    found = pieces.repartition(1).sortWithinPartitions("first").mapInPandas(digested, "digest string").first()
    return found["digest"] if found else hashlib.sha256().hexdigest()  # without ids there may be no task


@dataclass(frozen=True)
class Catalog:
    """fact_sets: the provenances in scope with their evidence; fields: code, version, name, ..., fact_set_code; metrics."""

    fact_sets: DataFrame
    fields: DataFrame
    metrics: DataFrame


def discovered(records: DataFrame, scope: Scope) -> DataFrame:
    """Record, item and unit counts of each record type and provenance in scope."""
    return visible(records, scope).groupBy("record_type", *ORIGIN).agg(*evidence_columns())


def present_fields(facts: FactSet, scope: Scope) -> DataFrame:
    """fact_set_code, field_code, field_version of the fields that a record in scope has; one pass, partial sums."""
    seen = visible(facts.df.filter(facts.predicate()), scope)
    found = seen.agg(*[F.max(facts.present(c)).alias(f"p{i}") for i, c in enumerate(facts.types)])
    rows = F.array(*[F.struct(F.lit(facts.code).alias("fact_set_code"), F.lit(c).alias("field_code"), F.lit(facts.field_versions.get(c, 1)).alias("field_version"), F.coalesce(f"p{i}", F.lit(False)).alias("there")) for i, c in enumerate(facts.types)])
    return found.select(F.inline(rows)).filter("there").drop("there")


def build_catalog(fact_sets: Sequence[FactSet], scope: Scope, versions: DataFrame, metrics: DataFrame) -> Catalog:
    """What may be asked in scope.

    versions: code, version, published_version, name, description, data_type, unit, aliases;
    metrics: code, version, status, enabled, fact_set_code, field_code, filter_fields. A fact
    set without records in scope, a field without a value or whose version isn't the published
    one, and a metric that lacks a field of its fact set are left out.
    """
    spark = versions.sparkSession
    known = spark.createDataFrame([(f.code, f.version, f.status, list(f.identity), list(f.dimensions), f.fingerprint()) for f in fact_sets], "code string, version int, status string, identity array<string>, dimensions array<string>, fingerprint string")
    counts = [visible(f.df.filter(f.predicate()), scope).agg(*evidence_columns()).withColumn("code", F.lit(f.code)) for f in fact_sets]
    counted = reduce(DataFrame.unionByName, counts).filter("record_count > 0")
    present = reduce(DataFrame.unionByName, [present_fields(f, scope) for f in fact_sets])
    published = versions.filter("version = published_version").withColumnsRenamed({"code": "field_code", "version": "field_version"})
    fields = present.join(published, ["field_code", "field_version"]).drop("published_version")
    own = fields.groupBy("fact_set_code").agg(F.array_sort(F.collect_set("field_code")).alias("field_codes"))
    sets = known.join(counted, "code").join(own, F.col("code") == F.col("fact_set_code"), "left").drop("fact_set_code").withColumn("field_codes", F.coalesce("field_codes", F.array().cast("array<string>")))
    need = F.array_distinct(F.concat(F.array("field_code"), F.coalesce("filter_fields", F.array().cast("array<string>"))))
    useful = metrics.filter("enabled AND status = 'published'").withColumn("needed", need).join(own, metrics["fact_set_code"] == own["fact_set_code"])
    useful = useful.filter(F.size(F.array_except("needed", "field_codes")) == 0).select(*[metrics[c] for c in metrics.columns])
    return Catalog(sets, fields, useful)


def search_text(*columns: Column) -> Column:
    """Columns and arrays of text in one lower-case string."""
    return F.lower(F.concat_ws(" ", *columns))


def describe(found: Catalog, field_codes: Iterable[str] = (), search: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fact sets and fields that hold all of field_codes and the text searched, at most 40 and 160, and one row that tells what was cut."""
    codes, term = sorted({c.strip() for c in field_codes if c.strip()}), search.strip().lower()
    wanted = F.array(*map(F.lit, codes)).cast("array<string>")
    holds = F.size(F.array_except(wanted, "field_codes")) == 0
    sets = found.fact_sets.filter(holds & F.contains(search_text(F.col("code"), F.col("field_codes")), F.lit(term)))
    shown = sets.orderBy("code").limit(MOST_FACT_SETS)
    listed = shown.select(F.explode("field_codes").alias("field_code")).distinct().withColumn("listed", F.lit(True))
    named = found.fields.groupBy("field_code", "field_version").agg(F.first("name").alias("name"), F.first("description").alias("description"), F.first("data_type").alias("data_type"), F.first("aliases").alias("aliases"), F.array_sort(F.collect_set("fact_set_code")).alias("fact_set_codes"))
    marked = named.join(listed, "field_code", "left")
    hit = F.contains(search_text(F.col("field_code"), F.col("name"), F.col("description"), F.col("aliases")), F.lit(term))
    fields = marked.filter((hit | F.col("listed")) if not codes else F.coalesce("listed", F.lit(False))).drop("listed")
    told = sets.agg(F.count(F.lit(1)).alias("matched_fact_sets")).crossJoin(fields.agg(F.count(F.lit(1)).alias("matched_fields")))  # a row against a row
    told = told.withColumns({"fact_sets_truncated": F.col("matched_fact_sets") > MOST_FACT_SETS, "fields_truncated": F.col("matched_fields") > MOST_FIELDS})
    return shown, fields.orderBy("field_code", "field_version").limit(MOST_FIELDS), told
