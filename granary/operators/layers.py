"""Template matching in layers: header to region template, regions to a sheet's composition, sheets to a workbook's route.

Each layer holds sets against a published catalog. Sets that are equal are one; a catalog entry is
met through its rarest members, of which anything that covers a bounded share of it must hold one.
What a high bound settles leaves, and only the rest meets the catalog with a lower bound, in the end
with any member that it shares. So no layer lists the pairs of a frequent member's holders unless nothing
rarer tells them apart, and the best entry is found exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import label_key
from ..sources.work import written
from .listing import best
from .matching import PENALTY, digest

FULL, LEFT_OVER = 10_000, 500  # fixed values: basis points of a full cover; what a member that no slot takes costs
FREQUENT = 63  #: keys that are compared as bits of a number
SENT = 500_000  #: keys of a catalog's entries that may go to every task
BOUNDS = (0.85, 0.6, 0.4, 0.0)  #: shares of an entry by which it is met, in turn


def numbered(rows: DataFrame, owner: str, member: str, order: Sequence[str]) -> DataFrame:
    """rows with key: the member and how many times the owner has had it, so that a multiset is a set."""
    place = F.row_number().over(Window.partitionBy(owner, member).orderBy(*order))
    return rows.withColumn("key", F.concat_ws("#", F.col(member), place.cast("string")))


def points(share: Column) -> Column:
    """A share in basis points, half to even."""
    return F.bround(FULL * share, 0).cast("long")


def in_order(sets: DataFrame, number: str, size: str, held: DataFrame, tops: DataFrame) -> DataFrame:
    """A row for each key of each set, with its place from the rarest on; the set's frequent keys as bits, the others as rest, in that order."""
    own = Window.partitionBy(number)
    each = sets.select(number, size, F.explode("keys").alias("key")).join(held, "key", "left").join(F.broadcast(tops), "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rest = F.array_sort(F.collect_list(F.when(F.col("bit").isNull(), F.struct("df", "key"))).over(own))["key"]
    return each.select(number, size, "key", "bit", F.row_number().over(own.orderBy("df", "key")).alias("place"), F.coalesce(F.sum("bit").over(own), F.lit(0)).alias("bits"), rest.alias("rest"))


def settled(left: DataFrame, right: DataFrame, score: Callable[[Column, Column, Column, Column, Column], Column], bounds: Sequence[float] = BOUNDS, both: bool = False) -> tuple[DataFrame, DataFrame]:
    """left with sig, which stands for its keys and told, and for each sig that scores: sig, right_id, score, shared; see best_covered.

    A pair is made at its rarest common key alone, so pairs are neither shuffled nor made twice. A score hangs on what is
    shared, on sizes and on what is told, so of the entries of a set that are equal in these only the smallest
    right_id is scored: what is kept of a set doesn't grow with the catalog.
    """
    spark = left.sparkSession
    clean = lambda df: df.withColumn("keys", F.array_sort(F.array_distinct(F.array_compact("keys"))))
    named = clean(left).withColumn("sig", digest("keys", "told"))
    sigs = written(named.select("sig", "keys", "told").distinct().withColumn("set", digest("keys")))
    sets = written(sigs.select("set", "keys").distinct().withColumns({"na": F.size("keys"), "set_no": F.monotonically_increasing_id()}))
    catalog = clean(right).filter(F.size("keys") > 0)
    # Numbers in the order of right_id stand for it.
    ids = written(catalog.select("right_id").distinct().orderBy("right_id").withColumn("right_no", F.monotonically_increasing_id()))
    variants = written(catalog.join(ids, "right_id").groupBy("keys", "told").agg(F.min("right_no").alias("right_no")))
    entries = written(variants.select("keys").distinct().withColumns({"nb": F.size("keys"), "entry_no": F.monotonically_increasing_id()}))
    variants = variants.join(entries, "keys").select("entry_no", F.col("told").alias("tb"), "right_no")
    held = written(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df")))
    tops = held.orderBy(F.col("df").desc(), F.col("key").desc()).limit(FREQUENT).withColumn("at", F.row_number().over(Window.orderBy("df", "key")) - 1)
    tops = written(tops.select("key", F.expr("shiftleft(1L, at)").alias("bit")))
    asked, offered = written(in_order(sets, "set_no", "na", held, tops)), written(in_order(entries, "entry_no", "nb", held, tops).withColumnsRenamed({"place": "place_b", "bits": "bits_b", "rest": "rest_b"}).drop("bit"))
    small = offered.count() <= SENT
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found, open_ = [], sigs.join(sets.select("set", "set_no", "na"), "set").select("sig", "set_no", "na", F.col("told").alias("ta"))
    for bound in bounds:
        # A share just below the bound may be rounded up to it.
        low = bound - 1 / FULL
        leading = lambda place, n: F.col(place) <= F.col(n) - F.greatest(F.ceil(F.col(n) * low - 1e-9), F.lit(1)) + 1  # noqa: E731, B023
        a, b = asked.join(open_.select("set_no").distinct(), "set_no", "left_semi"), offered.filter(leading("place_b", "nb"))
        a = (a.filter(leading("place", "na")) if both else a).repartition(tasks, "set_no", "key")
        bits, empty = F.col("bits").bitwiseAND(F.col("bits_b")), F.array().cast("array<string>")
        rest = F.when((F.size("rest") > 0) & (F.size("rest_b") > 0), F.array_intersect("rest", "rest_b")).otherwise(empty)
        met = a.join(F.broadcast(b) if small else b, "key").withColumns({"common": bits, "others": rest})
        shared = F.bit_count("common") + F.size("others")
        rarest = F.when(F.size("others") > 0, F.col("key") == F.get("others", F.lit(0))).otherwise(F.col("bit") == F.col("common").bitwiseAND(-F.col("common")))
        met = met.filter(rarest).select("set_no", "entry_no", "na", "nb", shared.alias("shared")).filter(F.col("shared") >= F.col("nb") * low)
        met = met.filter(F.col("shared") >= F.col("na") * low) if both else met
        alike = met.join(variants, "entry_no").groupBy("set_no", "shared", "nb", "tb").agg(F.min("right_no").alias("right_no"))
        scored = open_.join(alike, "set_no").withColumn("score", score(F.col("shared"), F.col("na"), F.col("nb"), F.col("ta"), F.col("tb")))
        top = scored.filter((F.col("score") > 0) & (F.col("score") >= FULL * bound)).groupBy("sig").agg(F.min(F.struct((-F.col("score")).alias("behind"), "right_no", "shared")).alias("m"))
        led = written(top.select("sig", "m.right_no", (-F.col("m.behind")).alias("score"), "m.shared"))
        found.append(led)
        open_ = open_.join(led.select("sig"), "sig", "left_anti")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return named, every.join(ids, "right_no").select("sig", "right_id", "score", "shared")


def best_covered(left: DataFrame, right: DataFrame, score: Callable[[Column, Column, Column, Column, Column], Column], bounds: Sequence[float] = BOUNDS, both: bool = False) -> DataFrame:
    """The entry of right with the highest score for each row of left, ties to the smallest right_id: left_id, right_id, score, shared.

    left: left_id, keys (array), told; right: right_id, keys, told, a row for each variant of an entry. told is a struct that
    score may use: score(shared, size of left, size of right, left told, right told), which must not exceed the
    share of right's keys in basis points; nor that of left's, if both is set, which leaves fewer pairs. Rows that score nothing have no row here. Repeated
    and null keys count once and not at all.
    """
    named, every = settled(left, right, score, bounds, both)
    return named.select("left_id", "sig").join(every, "sig").drop("sig")


def header_score(shared: Column, n_left: Column, n_right: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity of two header sets less what each structural mismatch costs.

    left, right: columns, header_depth, kind. Depths may differ between equal sets, and an
    unknown kind differs from none.
    """
    union = n_left + n_right - shared
    known = lambda kind: kind.isNotNull() & (kind != "unknown")
    depth = ((shared < n_left) | (shared < n_right)) & ~left["header_depth"].eqNullSafe(right["header_depth"])
    kinds = F.coalesce(known(left["kind"]) & known(right["kind"]) & (left["kind"] != right["kind"]), F.lit(False))
    mismatches = sum((c.cast("int") for c in (~left["columns"].eqNullSafe(right["columns"]), depth, kinds)), F.lit(0))
    return F.greatest(F.lit(0).cast("long"), points(shared / union) - PENALTY * mismatches)


def slot_score(shared: Column, n_left: Column, n_right: Column, left: Column, right: Column) -> Column:
    """The share of the slots that are filled, less what each member without a slot costs."""
    return F.greatest(F.lit(0).cast("long"), points(shared / n_right) - LEFT_OVER * (n_left - shared))


def anchored(cells: DataFrame, regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Form templates whose labels all stand where a region has them, two at least: region_id, version_id.

    cells: sheet_id, row, col, value; regions: sheet_id, region_id, top, left, bottom, right;
    anchors: version_id, row_offset, col_offset, label. Labels meet by place and text, so a
    region meets no template that it shares no label with.
    """
    inside = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    seen = cells.join(regions, "sheet_id").filter(inside).select("region_id", (F.col("row") - F.col("top")).alias("row_offset"), (F.col("col") - F.col("left")).alias("col_offset"), label_key(F.col("value")).alias("label"))
    asked = anchors.select("version_id", "row_offset", "col_offset", label_key(F.col("label")).alias("label"))
    total = asked.groupBy("version_id").agg(F.count(F.lit(1)).alias("total")).filter("total >= 2")
    hits = seen.filter("label <> ''").join(asked, ["row_offset", "col_offset", "label"]).groupBy("region_id", "version_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(total, "version_id").filter("hits = total").select("region_id", "version_id")


def best_headers(headers: DataFrame, versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Of each region the header that the catalog supports best, with version_id and score of the version that is nearest to it.

    headers: region_id, header_id, labels, columns, header_depth, kind, fingerprint, source,
    confidence, is_default, header_rows. versions: version_id, labels, columns, header_depth,
    kind, fingerprint, a row for each variant of a version. evidence: version_id, source, region_id of regions that
    people have tied to a version. In order: verified, equal fingerprint, score, confidence, the parser's default,
    fewer rows, header_id.
    """
    told = F.struct(F.col("columns").cast("long").alias("columns"), F.col("header_depth").cast("long").alias("header_depth"), "kind").alias("told")
    named, near = settled(headers.withColumns({"keys": F.col("labels"), "told": told}), versions.select(F.col("version_id").alias("right_id"), F.col("labels").alias("keys"), told), header_score, both=True)
    near = near.select("sig", F.col("right_id").alias("version_id"), "score")
    proved = evidence.select("source", "region_id").distinct().withColumn("verified", F.lit(True))
    same = versions.select("fingerprint").dropna().distinct().withColumn("same", F.lit(True))
    full = named.join(near, "sig", "left").drop("sig", "keys", "told").join(proved, ["source", "region_id"], "left").join(same, "fingerprint", "left")
    full = full.withColumns({"score": F.coalesce("score", F.lit(0)), "verified": F.coalesce("verified", F.lit(False)), "same": F.coalesce("same", F.lit(False))})
    order = [F.col("verified").desc(), F.col("same").desc(), F.col("score").desc(), F.col("confidence").desc(), F.col("is_default").desc(), F.col("header_rows"), F.col("header_id")]
    return best(full, ["region_id"], order)


def match_regions(chosen: DataFrame, versions: DataFrame, evidence: DataFrame, forms: DataFrame | None = None, fields: DataFrame | None = None, version_fields: DataFrame | None = None) -> DataFrame:
    """One row per region: region_id, header_id, version_id, score, match_type (exact, partial, none), matched_by.

    chosen: as best_headers gives it, with column_ids; versions: also validated (boolean) and
    bound (array of column ids). Exact are versions that are verified for the region, whose form labels it has (forms: see
    anchored) or whose fingerprint it has; of several the verified, then the validated, then that with the most bound
    columns in the region, then the greatest id. Else a score of 10,000 is exact; and a partial match is, where the region's
    fields (region_id, code; null where a column is open) are those of a version (version_id,
    code), each as often: of several that with the highest score, then the greatest id.
    """
    one = versions.groupBy("version_id").agg(F.max("validated").alias("validated"), F.first("bound").alias("bound"))
    ties = chosen.select("region_id", "source").join(evidence, ["source", "region_id"]).select("region_id", "version_id", F.lit(1).alias("verified"))
    prints = chosen.join(versions.select(F.col("version_id").alias("v"), "fingerprint").distinct(), "fingerprint").select("region_id", F.col("v").alias("version_id"), F.lit(0).alias("verified"))
    able = ties.unionByName(prints)
    if forms is not None:
        able = able.unionByName(forms.select("region_id", "version_id", F.lit(0).alias("verified")))
    able = able.groupBy("region_id", "version_id").agg(F.max("verified").alias("verified")).join(one, "version_id").join(chosen.select("region_id", "column_ids"), "region_id")
    n_bound = F.size(F.array_intersect(F.coalesce("bound", F.array().cast("array<string>")), F.coalesce("column_ids", F.array().cast("array<string>"))))
    exact = best(able, ["region_id"], [F.col("verified").desc(), F.col("validated").desc(), n_bound.desc(), F.col("version_id").desc()]).select("region_id", F.col("version_id").alias("exact_id"))
    full = chosen.join(exact, "region_id", "left")
    how = F.when(F.col("exact_id").isNotNull(), "region_template_fingerprint").when(F.col("score") == FULL, "normalized_region_signature")
    full = full.withColumn("matched_by", how).withColumn("version_id", F.coalesce("exact_id", "version_id"))
    if fields is not None and version_fields is not None:
        bag = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("bag"), F.count(F.when(F.col("code").isNull(), 1)).alias("open"))
        open_ = full.filter(F.col("matched_by").isNull() & (F.col("score") > 0)).select("region_id", "labels", F.struct("columns", "header_depth", "kind").alias("ta"))
        pairs = bag(fields, "region_id").filter("open = 0").join(bag(version_fields, "version_id"), "bag").select("region_id", "version_id").join(open_, "region_id")
        pairs = pairs.join(versions.select("version_id", F.col("labels").alias("b"), F.struct("columns", "header_depth", "kind").alias("tb")), "version_id")
        shared = F.size(F.array_intersect("labels", "b"))
        pairs = pairs.withColumn("near", header_score(shared, F.size(F.array_distinct("labels")), F.size(F.array_distinct("b")), F.col("ta"), F.col("tb")))
        meant = best(pairs, ["region_id"], [F.col("near").desc(), F.col("version_id").desc()]).select("region_id", F.col("version_id").alias("meant_id"))
        full = full.join(meant, "region_id", "left").withColumn("matched_by", F.coalesce("matched_by", F.when(F.col("meant_id").isNotNull(), "semantic_field_signature")))
        full = full.withColumn("version_id", F.coalesce("meant_id", "version_id"))
    kind = F.when(F.col("matched_by").isNotNull(), "exact").when(F.col("score") > 0, "partial").otherwise("none")
    return full.select("region_id", "header_id", "version_id", F.when(kind == "exact", F.lit(FULL).cast("long")).otherwise(F.col("score")).alias("score"), kind.alias("match_type"), "matched_by")


def match_slots(owners: DataFrame, members: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sheets against compositions, or workbooks against routes: a row per owner, and the slots that are filled.

    owners: owner_id; members: owner_id, member (the entry that a part matched exactly), part_id; slots:
    entry_id, slot_key, ordinal, member, required, materialize. A part fills the first open slot of its
    member, parts in order of their ids. The first table has owner_id, entry_id, score, total_slots,
    matched_slots, coverage, missing (required slots), unknown (members without a slot), match_type; the second owner_id,
    slot_key, part_id, materialize. An owner whose parts fill no slot of any entry matches none; null members take no part.
    """
    there = members.filter(F.col("member").isNotNull())
    slot = written(numbered(slots, "entry_id", "member", ["ordinal", "slot_key"]))
    none = F.struct(F.lit(0).alias("none")).alias("told")
    # An owner's members are counted and gathered by one shuffle; owners that have the same are one from here on.
    counted = there.repartition("owner_id").groupBy("owner_id", "member").agg(F.count(F.lit(1)).cast("int").alias("n"))
    had = written(counted.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("member", "n"))).alias("bag")).withColumn("sig", digest("bag")))
    bags = written(had.select("sig", "bag").distinct())
    each = F.flatten(F.transform("bag", lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.struct(x["member"].alias("member"), F.concat_ws("#", x["member"], i.cast("string")).alias("key")))))
    held = bags.select("sig", F.explode(each).alias("x")).select("sig", "x.member", "x.key")
    left = bags.select(F.col("sig").alias("left_id"), F.transform(each, lambda x: x["key"]).alias("keys"), none)
    right = slot.groupBy(F.col("entry_id").alias("right_id")).agg(F.collect_list("key").alias("keys")).select("right_id", "keys", none)
    led = written(best_covered(left, right, slot_score).select(F.col("left_id").alias("sig"), F.col("right_id").alias("entry_id"), "score", "shared"))
    sized = slot.groupBy("entry_id").agg(F.count(F.lit(1)).alias("total"))
    filled = led.select("sig", "entry_id").join(slot, "entry_id").join(held.select("sig", "key", F.lit(True).alias("there")), ["sig", "key"], "left")
    missing = filled.groupBy("sig").agg(F.array_sort(F.collect_list(F.when(F.col("there").isNull() & F.col("required"), F.struct("ordinal", "slot_key"))))["slot_key"].alias("missing"))
    taken = filled.filter("there").select("sig", "key")
    unknown = held.join(taken, ["sig", "key"], "left_anti").groupBy("sig").agg(F.array_sort(F.collect_list("member")).alias("unknown"))
    told = written(bags.select("sig").join(led.join(sized, "entry_id"), "sig", "left").join(missing, "sig", "left").join(unknown, "sig", "left"))
    full = owners.select("owner_id").distinct().join(had.select("owner_id", "sig"), "owner_id", "left").join(told, "sig", "left")
    empty = F.array().cast("array<string>")
    full = full.withColumns({"missing": F.coalesce("missing", empty), "unknown": F.coalesce("unknown", empty), "total_slots": F.coalesce("total", F.lit(0)).cast("long"), "matched_slots": F.coalesce("shared", F.lit(0)).cast("long"), "score": F.coalesce("score", F.lit(0)).cast("long")})
    exact = F.col("entry_id").isNotNull() & (F.size("missing") == 0) & (F.size("unknown") == 0) & (F.col("matched_slots") == F.col("total_slots"))
    coverage = F.when(F.col("total_slots") > 0, points(F.col("matched_slots") / F.col("total_slots"))).otherwise(F.lit(0).cast("long"))
    kind = F.when(exact, "exact").when(F.col("score") > 0, "partial").otherwise("none")
    table = full.select("owner_id", "entry_id", "score", "total_slots", "matched_slots", coverage.alias("coverage"), "missing", "unknown", kind.alias("match_type"))
    # Parts come in only here, where each takes its place.
    parts = numbered(there, "owner_id", "member", ["part_id"]).join(had.select("owner_id", "sig"), "owner_id")
    placed = parts.join(filled.filter("there").select("sig", "key", "slot_key", "materialize"), ["sig", "key"])
    return table, placed.select("owner_id", "slot_key", "part_id", "materialize")


def match_items(regions: DataFrame) -> DataFrame:
    """regions: item_id, region_id, version_id, score, match_type. One row per item: total, matched, coverage, score, match_type and the version if only one matched."""
    exact = F.col("match_type") == "exact"
    told = regions.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("total_regions"), F.count(F.when(exact, 1)).alias("matched_regions"), F.max("score").alias("most"),
        F.min(F.when(exact, F.col("version_id"))).alias("first"), F.max(F.when(exact, F.col("version_id"))).alias("last"),
    )
    coverage = points(F.col("matched_regions") / F.col("total_regions"))
    kind = F.when(F.col("matched_regions") == F.col("total_regions"), "exact").when((F.col("matched_regions") > 0) | (F.col("most") > 0), "partial").otherwise("none")
    score = F.when(kind == "exact", F.lit(FULL).cast("long")).when(kind == "partial", coverage).otherwise(F.lit(0).cast("long"))
    return told.select("item_id", "total_regions", "matched_regions", coverage.alias("coverage"), score.alias("score"), kind.alias("match_type"), F.when(F.col("first") == F.col("last"), F.col("first")).alias("version_id"))
