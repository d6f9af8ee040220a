"""Approval of import plans, for whole tables of requests: each gets its first problem, or its revision.

A plan takes the regions that templates fit exactly as they are, and new decisions for the others. What it takes
must be there, be allowed for the plan's source, belong to the file, lie apart, and replace no finished plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The status that a template must have for a plan of each source, and that a proposal must have.
TEMPLATE_STATUS = {"template": "published", "proposed": "user_confirmed", "provisional": "admin_review"}
PROPOSAL_STATUS = {"proposed": "accepted", "provisional": "pending"}


def first_problem(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; a rule that is null doesn't."""
    found = F.lit(None).cast("string")
    for when, name in reversed(rules):
        found = F.when(F.coalesce(when, F.lit(False)), F.lit(name)).otherwise(found)
    return found


def merged_decisions(matches: DataFrame, decided: DataFrame) -> DataFrame:
    """The regions of each plan: plan_id, item_id, region_id, header_id, origin (reused, new, open), materialize, and the range.

    matches: item_id, region_id, header_id, match_type, materialize, data_top, data_bottom, data_left, data_right, what the layers made of each
    region; decided: plan_id, item_id, region_id, header_id, materialize and a range, the new decisions. A decision about a
    region that a template fits gives way to the template; a region with neither is open.
    """
    box = ["data_top", "data_bottom", "data_left", "data_right"]
    plans = decided.select("plan_id", "item_id").distinct()
    own = plans.join(matches, "item_id").withColumn("fits", F.col("match_type") == "exact")
    reused = own.filter("fits").select("plan_id", "item_id", "region_id", "header_id", F.lit("reused").alias("origin"), F.coalesce("materialize", F.lit(True)).alias("materialize"), *box)
    fresh = decided.join(own.filter("fits").select("plan_id", "region_id"), ["plan_id", "region_id"], "left_anti")
    fresh = fresh.select("plan_id", "item_id", "region_id", "header_id", F.lit("new").alias("origin"), F.coalesce("materialize", F.lit(True)).alias("materialize"), *box)
    open_ = own.filter("not coalesce(fits, false)").join(fresh.select("plan_id", "region_id"), ["plan_id", "region_id"], "left_anti")
    open_ = open_.select("plan_id", "item_id", "region_id", "header_id", F.lit("open").alias("origin"), F.lit(False).alias("materialize"), *box)
    return reused.unionByName(fresh).unionByName(open_)


def overlapping(ranges: DataFrame) -> DataFrame:
    """plan_id of plans two of whose materialized ranges of a sheet share a cell.

    ranges: plan_id, sheet, region_id, data_top, data_bottom, data_left, data_right. The ranges of a sheet are cut at every row where one begins
    or has ended, so that within a strip only columns count; there, in order of the left end, a range that begins before
    the greatest right end so far overlaps one. Strips are as many as range ends, and no two ranges are paired.
    """
    key = ["plan_id", "sheet"]
    # Dealt by sheet once: cuts, strips and what they hold stay where the sheet is.
    ranges = ranges.select(*key, "data_top", "data_bottom", "data_left", "data_right").repartition(*key)
    cuts = ranges.select(*key, F.explode(F.array(F.col("data_top"), F.col("data_bottom") + 1)).alias("at")).distinct()
    order = Window.partitionBy(*key).orderBy("at")
    strips = cuts.withColumn("next", F.lead("at").over(order)).filter("next is not null")
    held = ranges.join(strips, key).filter("data_top <= at and data_bottom >= next - 1").select(*key, "at", "data_left", "data_right")
    before = Window.partitionBy(*key, "at").orderBy("data_left", "data_right").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("reach", F.max("data_right").over(before)).filter("data_left <= reach").select("plan_id").distinct()


def approve(requests: DataFrame, items: DataFrame, templates: DataFrame, proposals: DataFrame, regions: DataFrame, headers: DataFrame, plans: DataFrame) -> DataFrame:
    """plan_id, problem, revision, supersedes: each request's first problem, or the revision it becomes.

    requests: plan_id, item_id, source (template, proposed, provisional), template_id, template_version, proposal_id, supersedes, digest (of
    its regions and fields). items: item_id, active, total_regions (null without evidence). templates: template_id, version, status,
    retired, proposal_id. proposals: proposal_id, item_id, status, retired. regions: see merged_decisions, with sheet. headers: region_id,
    header_id. plans: plan_id, item_id, revision, source, template_id, template_version, proposal_id, digest, status, those that are
    approved. A request that asks for just what its file's latest plan holds is that plan, problem unchanged. Of several requests for one
    file each is judged alone, against the plans that are approved.
    """
    known = templates.select("template_id", F.col("version").alias("template_version"), F.struct("status", "retired", F.col("proposal_id").alias("made_from")).alias("t"))
    asked = proposals.select("proposal_id", F.struct("item_id", "status", "retired").alias("p"))
    newest = Window.partitionBy("item_id").orderBy(F.col("revision").desc(), F.col("plan_id").desc())
    latest = plans.withColumn("place", F.row_number().over(newest)).filter("place = 1")
    latest = latest.select("item_id", F.struct("plan_id", "revision", "source", "template_id", "template_version", "proposal_id", "digest", "status").alias("l"))
    active = regions.filter("materialize and origin <> 'open'")
    owned = active.join(headers.select("region_id", "header_id").distinct().withColumn("owns", F.lit(True)), ["region_id", "header_id"], "left")
    told = regions.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_regions"), F.count(F.when(F.col("origin") == "open", 1)).alias("n_open"), F.count(F.when(F.col("origin") == "new", 1)).alias("n_new"))
    homeless = owned.filter("owns is null").select("plan_id").distinct().withColumn("homeless", F.lit(True))
    crossing = overlapping(active).withColumn("crossing", F.lit(True))
    full = requests.join(items, "item_id", "left").join(known, ["template_id", "template_version"], "left").join(asked, "proposal_id", "left").join(latest, "item_id", "left")
    full = full.join(told, "plan_id", "left").join(homeless, "plan_id", "left").join(crossing, "plan_id", "left")
    table = lambda pairs: F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), F.coalesce("source", F.lit("")))
    by_people = F.col("source").isin(*PROPOSAL_STATUS)
    replaces = (F.col("l.source") == "provisional") & (F.col("source") == "proposed") & F.col("l.proposal_id").eqNullSafe(F.col("proposal_id"))
    same = F.lit(True)
    for c in ("source", "template_id", "template_version", "proposal_id", "digest"):
        same &= F.col(f"l.{c}").eqNullSafe(F.col(c))
    has = F.col("l").isNotNull()
    rules = [
        (F.col("active").isNull(), "unknown_item"),
        (~F.col("active"), "item_deleted"),
        (table(TEMPLATE_STATUS).isNull(), "unknown_source"),
        (F.col("total_regions").isNull(), "evidence_missing"),
        (F.col("t").isNull() | (F.col("t.status") != table(TEMPLATE_STATUS)) | F.col("t.retired"), "template_unavailable"),
        (by_people & (F.col("p").isNull() | (F.col("p.item_id") != F.col("item_id")) | F.col("p.retired") | ~F.col("t.made_from").eqNullSafe(F.col("proposal_id"))), "proposal_of_other_file"),
        (by_people & (F.col("p.status") != table(PROPOSAL_STATUS)), "proposal_in_other_state"),
        (~by_people & F.col("proposal_id").isNotNull(), "proposal_not_allowed"),
        (F.coalesce("n_regions", F.lit(0)) != F.col("total_regions"), "regions_differ"),
        ((F.col("source") == "provisional") & (F.col("n_new") == 0), "nothing_new"),
        ((F.col("source") != "provisional") & (F.col("n_open") > 0), "regions_open"),
        (F.col("homeless"), "header_of_other_region"),
        (F.col("crossing"), "ranges_overlap"),
        (has & same, "unchanged"),
        (has & ~F.col("supersedes").eqNullSafe(F.col("l.plan_id")), "latest_not_superseded"),
        (has & (F.col("l.status") == "completed") & ~F.coalesce(replaces, F.lit(False)), "latest_completed"),
        (~has & F.col("supersedes").isNotNull(), "nothing_to_supersede"),
    ]
    problem = first_problem(rules)
    return full.select("plan_id", problem.alias("problem"), F.when(problem.isNull(), F.coalesce(F.col("l.revision"), F.lit(0)) + 1).when(problem == "unchanged", F.col("l.revision")).cast("int").alias("revision"), F.when(problem.isNull(), F.col("supersedes")).alias("supersedes"))
