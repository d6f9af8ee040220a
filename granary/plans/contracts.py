"""Contracts: what a fact set holds and what may be asked of it.

A fact set is stored wide: a record's columns, and for each field a column
f_<code> STRUCT<present BOOLEAN, v>. present tells a field that is there without a value
from one that is absent. A field's values in other roles than its own stand in columns
f_<code>@<role>; filters, groups and measures see the canonical one only. Contracts are
checked before any job starts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = ["record_id", "tenant_id", "unit_id", "item_id", "record_type", "provenance", "created_at", "quality_status"]
ORIGIN = ["region_template_id", "region_template_version", "template_id", "template_version", "approved_plan_id"]
PLACE = ["sheet_id", "region_id", "source_row"]
NUMERIC = {"integer", "decimal"}
OPS = {"eq", "in", "gt", "gte", "lt", "lte", "contains"}


class QueryError(ValueError):
    """The contract or the plan doesn't allow the question."""


class CoverageError(QueryError):
    """Groups don't account for all records."""


@dataclass(frozen=True)
class Measure:
    aggregations: tuple[str, ...]
    additive: bool = True
    grouped_distinct_count: bool = False


@dataclass(frozen=True)
class Filter:
    code: str
    op: str
    value: Any


@dataclass(frozen=True)
class Provenance:
    """What a fact set's records must come from."""

    kind: str  # region_template, document_template or approved_plan
    id: str
    version: int | None = None

    def __post_init__(self) -> None:
        if self.kind not in {"region_template", "document_template", "approved_plan"}:
            raise QueryError(f"unknown kind of provenance: {self.kind}")
        if (self.version is None) != (self.kind == "approved_plan"):
            raise QueryError("templates have a version, approved plans have none")

    def predicate(self) -> Column:
        if self.kind == "approved_plan":
            return F.col("approved_plan_id") == self.id
        label = "region_template" if self.kind == "region_template" else "template"
        return (F.col(f"{label}_id") == self.id) & (F.col(f"{label}_version") == self.version)


@dataclass(frozen=True)
class FactSet:
    code: str
    df: DataFrame = field(compare=False, repr=False)
    types: dict[str, str]
    version: int = 1
    status: str = "published"
    identity: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    measures: dict[str, Measure] = field(default_factory=dict)
    blocked: tuple[str, ...] = ()
    status_filters: tuple[Filter, ...] = ()
    record_type: str | None = None  # that of its records; the code if not named
    provenance: Provenance | None = None
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    field_versions: dict[str, int] = field(default_factory=dict)  # 1 if not named
    units: DataFrame | None = field(default=None, compare=False, repr=False)  # unit_id, name
    stored: bool = field(default=False, compare=False, repr=False)  # df is filtered from files that have a row for each record
    sources: DataFrame | None = field(default=None, compare=False, repr=False)  # item_id, file_name, relative_path, source_sha256
    lineage: DataFrame | None = field(default=None, compare=False, repr=False)  # record_id, field_code, source_sha256, sheet_id, source_cell_id, coordinate, display_value, normalizer

    def __post_init__(self) -> None:
        for name, codes in (("identity", self.identity), ("dimensions", self.dimensions), ("measures", tuple(self.measures))):
            if missing := [c for c in codes if c not in self.types]:
                raise QueryError(f"{name} not in the fact set: {', '.join(missing)}")
        for code, m in self.measures.items():
            if {"sum", "avg"} & set(m.aggregations) and self.types[code] not in NUMERIC:
                raise QueryError(f"{code} is not numeric")
            if {"min", "max"} & set(m.aggregations) and self.types[code] == "boolean":
                raise QueryError(f"{code} has no order")

    def published(self, status: str = "published") -> FactSet:
        return replace(self, status=status)

    def fingerprint(self) -> str:
        return fingerprint({"code": self.code, "version": self.version, "types": self.types, "identity": self.identity, "dimensions": self.dimensions, "measures": {k: asdict(m) for k, m in self.measures.items()}})

    def column(self, code: str) -> Column:
        if code not in self.types:
            raise QueryError(f"unknown field: {code}")
        return F.col(name(code))

    def predicate(self) -> Column:
        """Which records of a store are this fact set's."""
        own = F.col("record_type") == (self.record_type or self.code)
        return own & self.provenance.predicate() if self.provenance else own

    def value(self, code: str) -> Column:
        return self.column(code)["v"]

    def present(self, code: str) -> Column:
        return F.coalesce(self.column(code)["present"], F.lit(False))


@dataclass(frozen=True)
class Scope:
    """A frozen scope: which units and source items are visible, and up to when."""

    tenant_id: str
    units: tuple[str, ...]
    items: tuple[str, ...] = ()
    enforce_items: bool = False
    before: Any = None
    frozen: DataFrame | None = field(default=None, compare=False, repr=False)  # item_id: the visible items, in place of items

    def predicate(self) -> Column:
        seen = (F.col("tenant_id") == self.tenant_id) & F.col("unit_id").isin(list(self.units)) & (F.col("quality_status") == "passed")
        if self.frozen is None and (self.enforce_items or self.items):
            seen &= F.col("item_id").isin(list(self.items)) if self.items else F.lit(False)
        if self.before is not None:
            seen &= F.col("created_at") <= F.lit(self.before).cast("timestamp")
        return seen

    def fingerprint(self) -> str:
        return fingerprint(sorted(self.items))


def name(code: str, role: str = "") -> str:
    return "f_" + code.replace(".", "__") + (f"@{role}" if role else "")


def fingerprint(what: Any) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(what, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def require_published(facts: FactSet) -> None:
    if facts.status != "published":
        raise QueryError(f"{facts.code} is not a published fact set")


def require_open(facts: FactSet, codes: list[str], enforce: bool) -> None:
    if unknown := sorted(set(codes) - set(facts.types)):
        raise QueryError(f"unknown fields: {', '.join(unknown)}")
    if enforce and (closed := sorted(set(codes) & set(facts.blocked))):
        raise QueryError(f"the plan names blocked sensitive fields: {', '.join(closed)}")
