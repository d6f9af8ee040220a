"""Payloads as VARIANT: parsed once, read by path and type, opened in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT; null for null and for what isn't JSON."""
    return F.try_parse_json(text)


def at(payload: Column, path: str, kind: str = "string") -> Column:
    """The value at a path as a type; null where there is none or it isn't of the type."""
    return F.try_variant_get(payload, path, kind)


def length(payload: Column, path: str) -> Column:
    """How many members an array at a path has; 0 where there is none."""
    return F.coalesce(F.size(F.try_variant_get(payload, path, "array<variant>")), F.lit(0))


def opened(df: DataFrame, payload: str, path: str, *carry: str) -> DataFrame:
    """A row for each member of the array at a path: carry, ordinal (from 1), member (VARIANT). Rows without members have one, with nulls."""
    members = F.try_variant_get(F.col(payload), path, "array<variant>")
    return df.select(*carry, F.posexplode_outer(members).alias("_at", "member")).select(*carry, (F.col("_at") + 1).alias("ordinal"), "member")


def built(**members: Column) -> Column:
    """A JSON object of members, nulls too, in order of their names."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"})
