"""Declarations and transitions, checked for whole tables at once: each request gets its first problem, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written

# What an action needs and makes.
TRANSITIONS = {"confirm": ("draft", "user_confirmed"), "submit_review": ("user_confirmed", "admin_review"), "approve": ("admin_review", "published"), "reject": ("admin_review", "draft"), "deprecate": ("published", "deprecated")}


def ends_of_chains(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges: old_id, new_id, one per old_id. old_id, end: where its chain of replacements ends; a cycle is an error.

    A chain's reach doubles with each round, and each round is written, so a plan never holds more than one. Chains of n
    links need about log2(n) rounds; what goes on after that many for all edges is a cycle.
    """
    reach = written(edges.select("old_id", F.col("new_id").alias("end")))
    for _ in range(rounds or max(1, reach.count()).bit_length() + 1):
        further = reach.select(F.col("old_id").alias("end"), F.col("end").alias("further"))
        step = written(reach.join(further, "end", "left").select("old_id", "end", "further"))
        reach = step.select("old_id", F.coalesce("further", "end").alias("end"))
        if step.filter("further is not null").isEmpty():
            return reach
    raise ValueError("replacements form a cycle")


def supersession_problems(items: DataFrame, records: DataFrame, declared: DataFrame, wanted: DataFrame, units: list[str]) -> DataFrame:
    """items: item_id, unit_id, created_at; records: item_id, quality_status; declared, wanted: old_id, new_id.

    Each wanted declaration with its first problem; NULL if it may be declared. Of several for one old_id the least new_id comes first.
    """
    passed = records.filter("quality_status = 'passed'").select("item_id").distinct().withColumn("passed", F.lit(True))
    known = items.select("item_id", "unit_id", "created_at").join(passed, "item_id", "left")
    side = lambda label: known.select(F.col("item_id").alias(f"{label}_id"), F.struct("unit_id", "created_at", F.coalesce("passed", F.lit(False)).alias("passed"), F.lit(True).alias("there")).alias(label))
    first = F.row_number().over(Window.partitionBy("old_id").orderBy("new_id"))
    full = wanted.select("old_id", "new_id").distinct().withColumn("place", first).join(side("old"), "old_id", "left").join(side("new"), "new_id", "left")
    full = full.join(declared.select("old_id", F.lit(True).alias("again")).distinct(), "old_id", "left")
    full = full.join(ends_of_chains(declared).select(F.col("old_id").alias("new_id"), "end"), "new_id", "left")
    o, n = F.col("old"), F.col("new")
    rules = [
        (F.col("old_id") == F.col("new_id"), "self"),
        (o["there"].isNull() | n["there"].isNull(), "unknown_item"),
        (~o["unit_id"].isin(units) | ~n["unit_id"].isin(units), "outside_scope"),
        (o["unit_id"] != n["unit_id"], "other_unit"),
        (n["created_at"] < o["created_at"], "older"),
        (~o["passed"] | ~n["passed"], "no_passed_records"),
        (F.col("again").isNotNull() | (F.col("place") > 1), "already_declared"),
        (F.coalesce("end", "new_id") == F.col("old_id"), "cycle"),
    ]
    problem = F.lit(None).cast("string")
    for when, name in reversed(rules):
        problem = F.when(F.coalesce(when, F.lit(False)), name).otherwise(problem)
    return full.select("old_id", "new_id", problem.alias("problem"))


def transition(versions: DataFrame, requests: DataFrame, unpublished: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions: code, version, status; requests: code, version, action, comment, at most one per version; unpublished: code, version of those with fields that aren't published.

    The versions after the requests, and an event per request with its problem, or from and to.
    Approving a version deprecates the one that was published. A rejection needs a comment.
    """
    needs = F.create_map(*[F.lit(x) for a, (f, _) in TRANSITIONS.items() for x in (a, f)])
    makes = F.create_map(*[F.lit(x) for a, (_, t) in TRANSITIONS.items() for x in (a, t)])
    key = ["code", "version"]
    asked = requests.join(versions, key, "left").join(unpublished.select(*key, F.lit(True).alias("bad")).distinct(), key, "left")
    action = F.coalesce("action", F.lit(""))
    need = F.try_element_at(needs, action)
    problem = (
        F.when(need.isNull(), "unknown_action").when(F.col("status").isNull(), "unknown_version").when(F.col("status") != need, "wrong_state")
        .when((action == "reject") & (F.trim(F.coalesce("comment", F.lit(""))) == ""), "comment_missing").when((action == "approve") & F.col("bad").isNotNull(), "fields_unpublished")
    )
    events = asked.select(*key, "action", "comment", F.col("status").alias("from_status"), problem.alias("problem"), F.when(problem.isNull(), F.try_element_at(makes, action)).alias("to_status"))
    done = events.filter("problem is null").select(*key, "to_status")
    approved = done.filter("to_status = 'published'").groupBy("code").agg(F.max("version").alias("now"))
    after = versions.join(done, key, "left").join(approved, "code", "left")
    made = F.coalesce("to_status", "status")
    status = F.when((made == "published") & F.col("now").isNotNull() & (F.col("version") != F.col("now")), "deprecated").otherwise(made)
    return after.select(*key, status.alias("status")), events
