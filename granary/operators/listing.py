"""Listing and report operators: left joins to counts, paging, roll-ups, best per group, forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import basis_points


def with_count(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """left with the number of right's rows of its keys, 0 if none."""
    counted = right.groupBy(*keys).agg(F.count(F.lit(1)).alias(label))
    return left.join(counted, list(keys), "left").withColumn(label, F.coalesce(label, F.lit(0)).cast("long"))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page under a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def status_rollup(df: DataFrame, key: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Rows per key, in all and per status."""
    counts = [F.count(F.when(F.col(status) == s, 1)).alias(f"n_{s}") for s in statuses]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *counts)


def best(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; order must be total."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def margin(df: DataFrame, group: Sequence[str], score: str, tie: str) -> DataFrame:
    """The leader of each group, its score and its margin to the runner-up (the score itself if alone)."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    ranked = df.withColumn("_place", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0)))
    return ranked.filter("_place = 1").drop("_place")


def later_duplicates(df: DataFrame, identity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with duplicate: whether a row with the identity came before."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)) > 1)


def fill_down(df: DataFrame, value: str, group: Sequence[str], order: Sequence[Column], label: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(label, F.last(value, ignorenulls=True).over(w))


def fill_down_within(df: DataFrame, outer: str, inner: str, group: Sequence[str], order: Sequence[Column], labels: tuple[str, str]) -> DataFrame:
    """Two levels filled down: outer from its last value, inner from its last value since outer had one."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = df.withColumn("_stretch", F.count(outer).over(w)).withColumn(labels[0], F.last(outer, ignorenulls=True).over(w))
    return fill_down(told, inner, [*group, "_stretch"], order, labels[1]).drop("_stretch")


def left_chain(df: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """df with what each step's table has for it, left to right: (table, key in what is there, key in the table). Rows without a match stay, with nulls."""
    for table, here, there in steps:
        df = df.join(table, df[here] == table[there], "left").drop(table[there])
    return df


def numbered_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A multiset match: the i-th row of a key on the left meets the i-th on the right, each once."""
    w = Window.partitionBy(*keys).orderBy(order)
    number = lambda df: df.withColumn("_n", F.row_number().over(w))
    return number(left).join(number(right).withColumnRenamed(order, f"{order}_right"), [*keys, "_n"], "inner").drop("_n")


def clusters(df: DataFrame, fingerprint: Sequence[str], member: str, labels: str) -> DataFrame:
    """Rows with equal fingerprints: their number, and the union of their label arrays."""
    return df.groupBy(*fingerprint).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("first_member"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias("labels"))


def unit_tree(units: DataFrame, granted: DataFrame) -> DataFrame:
    """Allowed units: those granted and their direct children. units: unit_id, parent_id; granted: unit_id."""
    own = units.join(granted, "unit_id", "left_semi").select("unit_id")
    children = units.join(granted.withColumnRenamed("unit_id", "parent_id"), "parent_id", "left_semi").select("unit_id")
    return own.union(children).distinct()


def without_superseded(items: DataFrame, edges: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Items that no newer one replaces; an explicit selection is taken as it is. edges: old_id, new_id."""
    if selected is not None:
        return items.join(selected, "item_id", "left_semi")
    return items.join(edges.select(F.col("old_id").alias("item_id")), "item_id", "left_anti")


def merge_by_key(stored: DataFrame, incoming: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """A full outer merge by key, with what became of each row: inserted, updated, unchanged or extra."""
    a, b = stored.alias("a"), incoming.alias("b")
    same = F.lit(True)
    for v in values:
        same &= F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    what = F.when(F.col(f"a.{key}").isNull(), "inserted").when(F.col(f"b.{key}").isNull(), "extra").when(same, "unchanged").otherwise("updated")
    take = [F.when(what == "extra", F.col(f"a.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *take, what.alias("outcome"))


def page_with_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page, each row with the number of all rows as total."""
    return page(df, order, offset, limit).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))  # one row, sent to all tasks


def layout_clusters(files: DataFrame) -> DataFrame:
    """files: file_id, fingerprint, headers. Files of one layout: their number, members, and the headers that all and that any of them have.

    Headers are counted by layout: common are those that as many files have as have headers at all.
    """
    grouped = files.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file_id")).alias("members"), F.count("headers").alias("_whole"))
    held = files.select("fingerprint", F.explode(F.array_distinct("headers")).alias("header")).groupBy("fingerprint", "header").agg(F.count(F.lit(1)).alias("_n"))
    told = held.join(grouped.select("fingerprint", "_whole"), "fingerprint").groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("_whole"), F.col("header")))).alias("common"), F.array_sort(F.collect_list("header")).alias("all"))
    none = F.array().cast(files.schema["headers"].dataType)
    return grouped.join(told, "fingerprint", "left").select("fingerprint", "n", "members", F.coalesce("common", none).alias("common"), F.coalesce("all", none).alias("all"))


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys other doesn't hold; rows with a null key stay."""
    return df.join(other, list(keys), "left_anti")


def coverage_points(df: DataFrame, group: Sequence[str], covered: Column) -> DataFrame:
    """The share of covered rows in each group, in basis points."""
    counted = df.groupBy(*group).agg(F.count(F.when(covered, 1)).alias("_part"), F.count(F.lit(1)).alias("_whole"))
    return counted.select(*group, basis_points(F.col("_part"), F.col("_whole")).alias("points"))


def suffixed_roles(mappings: DataFrame) -> DataFrame:
    """mappings: region_id, code, place, role, base_role, preferred. Roles that are unique for each region and code.

    Of those without a role one stays the canonical: the first preferred, else the first by
    place. A role that is taken, and the others' base_role (else `duplicate`), get _2, _3, ...
    in order of place. Adds review: whether the role was changed.
    """
    key = ["region_id", "code"]
    blank = F.coalesce("role", F.lit("")) == ""
    first = Window.partitionBy(*key, blank).orderBy((~F.coalesce("preferred", F.lit(False))).cast("int"), "place")
    again = Window.partitionBy(*key, "role").orderBy("place")
    marked = mappings.withColumn("canonical", blank & (F.row_number().over(first) == 1)).withColumn("own", ~blank & (F.row_number().over(again) == 1))
    base = F.when(F.col("canonical"), "").when(F.col("own"), F.col("role")).otherwise(F.coalesce(F.nullif(F.col("base_role"), F.lit("")), F.lit("duplicate")))
    based = marked.withColumn("base", base)
    # Roles that were there come first, so a suffix begins after them.
    turn = F.row_number().over(Window.partitionBy(*key, "base").orderBy((~F.col("own")).cast("int"), "place"))
    return based.select(*key, "place", F.when(turn == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), turn)).alias("role"), (~F.col("canonical") & ~F.col("own")).alias("review"))


def children(df: DataFrame, parent: Sequence[str], child: str, count: str = "n") -> DataFrame:
    """Each parent with its number of rows and its children in order: name and rows."""
    leaves = df.groupBy(*parent, child).agg(F.count(F.lit(1)).alias("_n"))
    return leaves.groupBy(*parent).agg(F.sum("_n").alias(count), F.array_sort(F.collect_list(F.struct(F.col(child).alias("name"), F.col("_n").alias("n")))).alias("children"))


def source_summary(records: DataFrame, identity: Column) -> DataFrame:
    """What a source's bootstrap is held against: records, source rows, first and last row, provenances, identities there and distinct, per item."""
    passed = records.filter("quality_status = 'passed'").withColumn("_id", identity)
    return passed.groupBy("item_id").agg(
        F.countDistinct("record_id").alias("records"), F.countDistinct("source_row").alias("source_rows"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"),
        F.countDistinct(F.struct("template_id", "template_version")).alias("provenances"), F.count("_id").alias("identities"), F.countDistinct("_id").alias("distinct_identities"),
    )


def bootstrap_problems(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: item_id, records, first_row, last_row. item_id and the first problem, NULL if the source is as expected."""
    both = summary.alias("s").join(expected.alias("e"), "item_id", "full")
    n = F.col("e.records")
    problem = (
        F.when(F.col("s.records").isNull(), "no_records").when(n.isNull(), "not_expected")
        .when((F.col("s.records") != n) | (F.col("source_rows") != n) | (F.col("s.first_row") != F.col("e.first_row")) | (F.col("s.last_row") != F.col("e.last_row")), "other_rows")
        .when(F.col("provenances") != 1, "provenance_not_unique").when((F.col("identities") != n) | (F.col("distinct_identities") != n), "identity_not_unique")
    )
    return both.select("item_id", problem.alias("problem"))
