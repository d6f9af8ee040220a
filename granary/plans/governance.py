"""Contract tables: fact sets, manifests and metrics, published and looked up as whole tables.

Each publication takes a table of drafts and gives back every draft with its first problem, or
NULL and the status published. Nothing is changed in place; merging the result is the caller's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answers import metric
from .contracts import FactSet, Filter, QueryError, Scope

KINDS = ("region_template", "document_template", "approved_plan")


def _judged(drafts: DataFrame, rules: Sequence[tuple[Column, str]], keep: Sequence[str]) -> DataFrame:
    problem = F.lit(None).cast("string")
    for when, label in reversed(rules):
        problem = F.when(F.coalesce(when, F.lit(False)), label).otherwise(problem)
    judged = drafts.withColumn("problem", problem)
    return judged.select(*keep, F.when(F.col("problem").isNull(), "published").otherwise(F.col("status")).alias("status"), "problem")


def publish_fact_sets(drafts: DataFrame, fields: DataFrame) -> DataFrame:
    """drafts: code, version, status, provenance_kind, provenance_version, identity, referenced (arrays of field codes); fields: code of the published ones."""
    known = drafts.select("code", "version", F.explode(F.array_distinct(F.concat("identity", "referenced"))).alias("field"))
    missing = known.join(fields.select(F.col("code").alias("field")).distinct(), "field", "left_anti").groupBy("code", "version").agg(F.array_sort(F.collect_set("field")).alias("missing"))
    rules = [
        (F.col("status") != "draft", "not_a_draft"),
        (~F.col("provenance_kind").isin(*KINDS) | ((F.col("provenance_kind") != "approved_plan") & F.col("provenance_version").isNull()), "bad_provenance"),
        (F.size("missing") > 0, "unpublished_fields"),
        (F.size("identity") == 0, "no_identity"),
    ]
    return _judged(drafts.join(missing, ["code", "version"], "left"), rules, ["code", "version", "missing"])


def publish_manifests(drafts: DataFrame, fact_sets: DataFrame) -> DataFrame:
    """drafts: code, version, status, fact_set_code, fact_set_version, fingerprint, entities, root_entity, n_relationships, max_join_depth; fact_sets: code, version, status, fingerprint.

    A manifest belongs to the published version that it names and to that version's fingerprint.
    """
    own = fact_sets.filter("status = 'published'").select(F.col("code").alias("fact_set_code"), F.col("version").alias("fact_set_version"), F.col("fingerprint").alias("own_fingerprint"))
    rules = [
        (F.col("status") != "draft", "not_a_draft"),
        (F.col("own_fingerprint").isNull(), "fact_set_unpublished"),
        (~F.col("fingerprint").eqNullSafe(F.col("own_fingerprint")), "other_fingerprint"),
        (~F.array_contains("entities", F.col("root_entity")), "root_entity_undeclared"),
        ((F.col("n_relationships") > 0) & (F.col("max_join_depth") == 0), "no_join_depth"),
    ]
    return _judged(drafts.join(own, ["fact_set_code", "fact_set_version"], "left"), rules, ["code", "version"])


def publish_metrics(drafts: DataFrame, manifests: DataFrame, fields: DataFrame) -> DataFrame:
    """drafts: code, version, status, fact_set_code, fact_set_version, field_code; manifests: fact_set_code, fact_set_version, status; fields: code of the published ones."""
    key = ["fact_set_code", "fact_set_version"]
    own = manifests.filter("status = 'published'").select(*key, F.lit(True).alias("has_manifest")).distinct()
    known = fields.select(F.col("code").alias("field_code"), F.lit(True).alias("has_field")).distinct()
    rules = [
        (F.col("status") != "draft", "not_a_draft"),
        (F.col("has_manifest").isNull(), "no_manifest"),
        (F.col("has_field").isNull(), "unpublished_field"),
    ]
    return _judged(drafts.join(own, key, "left").join(known, "field_code", "left"), rules, ["code", "version"])


def current_metrics(metrics: DataFrame) -> DataFrame:
    """The highest published and enabled version of each metric."""
    usable = metrics.filter("enabled AND status = 'published'")
    last = Window.partitionBy("code").orderBy(F.col("version").desc())
    return usable.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")


def run_metric(metrics: DataFrame, fact_sets: dict[str, FactSet], scope: Scope, code: str, filters: tuple[Filter, ...] = (), version: int | None = None) -> DataFrame:
    """metric() by its code and version, or the latest: metrics has code, version, status, enabled, fact_set_code, field_code, aggregation, filter_fields. Adds metric_code and metric_version."""
    named = metrics.filter(F.col("code") == code)
    found = current_metrics(named if version is None else named.filter(F.col("version") == version)).head()
    if found is None:
        raise QueryError(f"no published metric: {code}")
    if found["fact_set_code"] not in fact_sets:
        raise QueryError(f"the metric's fact set is not available: {found['fact_set_code']}")
    if barred := sorted({f.code for f in filters} - set(found["filter_fields"] or [])):
        raise QueryError(f"the metric doesn't filter by: {', '.join(barred)}")
    answer = metric(fact_sets[found["fact_set_code"]], scope, found["aggregation"], found["field_code"], filters)
    return answer.select(F.lit(code).alias("metric_code"), F.lit(found["version"]).alias("metric_version"), *answer.columns)


def accepted_results(results: DataFrame) -> DataFrame:
    """results: run_id, status, n_rows, grade. Adds accepted: a success with rows that isn't a mere candidate."""
    why = F.when(F.col("status") != "success", "failed").when(F.col("n_rows") == 0, "empty").when(F.col("grade") == "candidate_only", "candidate_only")
    return results.withColumns({"accepted": why.isNull(), "reason": why})
