"""Table regions of sheets, and the header rows that suit them best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import written
from .components import components
from .listing import best

REGIONS = "workbook_id string, sheet int, region int, top int, left int, bottom int, right int, n_cells int, density double"
#: The weights of a header candidate's confidence.
WEIGHTS = {"base": 0.2, "coverage": 0.25, "uniqueness": 0.35, "text": 0.18, "hierarchy": 0.18, "contrast": 0.14, "style": 0.16, "plain": -0.35, "depth": -0.03, "added": -0.3}
DEEPEST, FIRST_ROWS, LEAST = 3, 8, 0.7
NEAR, DOMINANT = 0.05, 0.6  #: how close a richer header's confidence must be, and the largest share of one label above the leaves
LARGEST_MERGE = 10_000  #: cells; larger merges are ignored
SHEET_CELLS = 500_000  #: of a sheet that one task takes
BAND = 4096  #: rows of a rectangle, at most


def blocks(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A label for each cell: cells that touch at a side have one label."""
    label = np.arange(len(rows))
    sides = []
    for a, b in ((rows, cols), (cols, rows)):
        order = np.lexsort((b, a))
        touch = (np.diff(a[order]) == 0) & (np.diff(b[order]) == 1)
        sides.append((order[:-1][touch], order[1:][touch]))
    x, y = (np.concatenate(s) for s in zip(*sides, strict=True))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def find_regions(cells: DataFrame, most: int = SHEET_CELLS) -> DataFrame:
    """Connected blocks of non-empty cells of each sheet; a block inside the bounds of a larger one belongs to it.

    Sheets of at most so many cells are a group each; larger ones, as large CSV files are, are
    spread over tasks. Both give the same regions. Rows with an error hold no cells; repeated cells count once.
    """
    key = ["workbook_id", "sheet"]
    there = cells.filter("error is null").select(*key, "row", "col")
    large = written(there.groupBy(*key).count().filter(F.col("count") > most).select(*key))
    small = regions_by_sheet(there.join(large, key, "left_anti"))
    return small if large.isEmpty() else small.unionByName(regions_spread(there.join(large, key, "left_semi")))


def regions_by_sheet(there: DataFrame) -> DataFrame:
    """Regions of sheets that fit a task."""

    def of_sheet(pdf: pd.DataFrame) -> pd.DataFrame:
        workbook, sheet = pdf["workbook_id"].iloc[0], pdf["sheet"].iloc[0]
        pdf = pdf.drop_duplicates(["row", "col"])
        rows, cols = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        made = pd.DataFrame({"label": blocks(rows, cols), "row": rows, "col": cols}).groupby("label").agg(top=("row", "min"), left=("col", "min"), bottom=("row", "max"), right=("col", "max"), n_cells=("row", "size"))
        made["area"] = (made.bottom - made.top + 1) * (made.right - made.left + 1)
        made = made.sort_values(["area", "top", "left"], ascending=[False, True, True])
        kept: list = []
        for r in made.itertuples():
            home = next((k for k in kept if k["top"] <= r.top and k["left"] <= r.left and k["bottom"] >= r.bottom and k["right"] >= r.right), None)
            if home is not None:
                home["n_cells"] += r.n_cells
            else:
                kept.append({"top": r.top, "left": r.left, "bottom": r.bottom, "right": r.right, "n_cells": r.n_cells, "density": r.area})
        out = pd.DataFrame(kept).sort_values(["top", "left"]).reset_index(drop=True)
        out["density"] = out["n_cells"] / out["density"]
        out["region"], out["workbook_id"], out["sheet"] = out.index, workbook, sheet
        return out[[c.split()[0] for c in REGIONS.split(", ")]]

    return there.groupBy("workbook_id", "sheet").applyInPandas(of_sheet, REGIONS)


def regions_spread(there: DataFrame) -> DataFrame:
    """Regions of sheets of any size, by joins and windows over parts of them.

    Cells side by side are a run; equal runs of consecutive rows, up to BAND rows, are a rectangle; rectangles
    whose runs overlap in adjacent rows are connected. Blocks are the components of these.
    """
    key = ["workbook_id", "sheet"]
    cells = there.distinct()
    along = F.col("col") - F.row_number().over(Window.partitionBy(*key, "row").orderBy("col"))
    runs = cells.withColumn("island", along).groupBy(*key, "row", "island").agg(F.min("col").alias("left"), F.max("col").alias("right")).drop("island")
    band = F.floor(F.col("row") / BAND).alias("band")
    down = F.col("row") - F.row_number().over(Window.partitionBy(*key, "band", "left", "right").orderBy("row"))
    placed = runs.withColumn("band", band).withColumn("island", down)
    rectangle = F.xxhash64(*key, "band", "left", "right", "island")
    runs = written(placed.select(*key, "row", "left", "right", rectangle.alias("node")))
    upper, lower = runs.alias("u"), runs.withColumn("row", F.col("row") - 1).alias("l")
    touch = (F.col("u.left") <= F.col("l.right")) & (F.col("u.right") >= F.col("l.left"))
    same = [F.col(f"u.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*key, "row")]
    edges = upper.join(lower, same[0] & same[1] & same[2] & touch).select(F.col("u.node").alias("a"), F.col("l.node").alias("b")).filter("a <> b").distinct()
    rectangles = written(runs.groupBy(*key, "node").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.sum(F.col("right") - F.col("left") + 1).alias("n_cells")))
    label = components(rectangles.select("node"), edges)
    found = rectangles.join(label, "node").groupBy(*key, "label").agg(*[F.min(c).alias(c) for c in ("top", "left")], *[F.max(c).alias(c) for c in ("bottom", "right")], F.sum("n_cells").alias("n_cells"))
    found = written(found.withColumn("area", (F.col("bottom") - F.col("top") + 1).cast("long") * (F.col("right") - F.col("left") + 1)))
    home = homes(found)
    into = found.join(home, "label").groupBy(F.col("home").alias("label")).agg(F.sum("n_cells").alias("more"))
    left = found.join(home, "label", "left_anti").join(into, "label", "left")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("top", "left")) - 1
    n = (F.col("n_cells") + F.coalesce("more", F.lit(0))).cast("int")
    return left.select(*key, number.alias("region"), "top", "left", "bottom", "right", n.alias("n_cells"), (n / F.col("area")).alias("density"))


def homes(boxes: DataFrame) -> DataFrame:
    """label, home: of each box within others the largest of those, then the topmost, then the leftmost.

    Boxes meet by column and by bands of rows as high as the larger box, so only boxes that cover the
    same column nearby are held against each other.
    """
    key = ["workbook_id", "sheet"]
    height = F.col("bottom") - F.col("top") + 1
    level = F.ceil(F.log2(height)).cast("int")
    order = F.struct(-F.col("area"), "top", "left", "label")
    band_of = lambda row: F.floor(F.col(row) / F.pow(F.lit(2.0), F.col("level")))
    large = boxes.filter("area > 1").withColumn("level", level).withColumn("band", F.explode(F.array_distinct(F.array(band_of("top"), band_of("bottom")))))
    large = large.select(*key, "level", "band", F.explode(F.sequence("left", "right")).alias("col"), order.alias("o"), F.struct("top", "left", "bottom", "right").alias("b"))
    levels = [r["level"] for r in large.select("level").distinct().collect()]  # one for each power of two
    if not levels:
        return boxes.select("label", F.col("label").alias("home")).limit(0)
    asked = boxes.withColumn("own", level).withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).filter("level >= own")
    asked = asked.select("label", *key, "level", band_of("top").alias("band"), F.col("left").alias("col"), order.alias("own"), "top", "left", "bottom", "right")
    within = (F.col("b.top") <= F.col("top")) & (F.col("b.left") <= F.col("left")) & (F.col("b.bottom") >= F.col("bottom")) & (F.col("b.right") >= F.col("right")) & (F.col("o") < F.col("own"))
    met = asked.join(large, [*key, "level", "band", "col"]).filter(within)
    return met.groupBy("label").agg(F.min("o").alias("o")).select("label", F.col("o.label").alias("home"))


def without_formulas_only(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Regions in which some cell isn't a formula."""
    key = ["workbook_id", "sheet"]
    inside = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    own = regions.join(cells.filter("formula is null").select(*key, "row", "col"), key).filter(inside).select(*key, "region").distinct()
    return regions.join(own, [*key, "region"], "left_semi")


def with_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """cells, and a cell with the anchor's value at each other place of a merge that has none; merged tells them apart.

    merges: workbook_id, sheet, top, left, bottom, right.
    """
    key = ["workbook_id", "sheet"]
    area = (F.col("bottom") - F.col("top") + 1) * (F.col("right") - F.col("left") + 1)
    anchor = cells.select(*key, F.col("row").alias("top"), F.col("col").alias("left"), F.struct("value", *[c for c in ("style", "hidden", "error", "formula") if c in cells.columns]).alias("anchor"))
    places = merges.filter(area <= LARGEST_MERGE).join(anchor, [*key, "top", "left"])
    places = places.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right")))
    places = places.join(cells.select(*key, "row", "col"), [*key, "row", "col"], "left_anti")
    own = [c for c in cells.columns if c not in (*key, "row", "col")]
    known = set(places.schema["anchor"].dataType.names)
    more = places.select(*key, "row", "col", *[(F.col(f"anchor.{c}") if c in known else F.lit(None).cast(cells.schema[c].dataType)).alias(c) for c in own], F.lit(True).alias("merged"))
    return cells.withColumn("merged", F.lit(False)).unionByName(more.dropDuplicates([*key, "row", "col"]))


def header_candidates(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """For each region, the rows start ... start + depth - 1 as its header, with a confidence.

    A column's path is its texts in those rows, repeats left out, and its label the last of
    them. Labels that cover the columns, differ and are words speak for a header, and so do
    paths of several levels, numbers in the row below and another style than the rows below
    have; a last row in the body's style speaks against it. cells: see with_merged for merges;
    style may be missing.
    """
    key = ["workbook_id", "sheet", "region"]
    inside = (F.col("row") >= F.col("top")) & (F.col("row") <= F.col("bottom")) & (F.col("col") >= F.col("left")) & (F.col("col") <= F.col("right"))
    style = F.col("style") if "style" in cells.columns else F.lit(None).cast("string")
    merged = F.col("merged") if "merged" in cells.columns else F.lit(False)
    read = cells.select("workbook_id", "sheet", "row", "col", "value", style.alias("style"), merged.alias("merged"))
    body = regions.filter("bottom > top").join(read, ["workbook_id", "sheet"]).filter(inside).filter("row <= top + 13")
    starts = F.sequence(F.col("top"), F.least(F.col("bottom") - 1, F.col("top") + FIRST_ROWS - 1))
    tries = body.withColumn("start", F.explode(starts)).withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(DEEPEST)))).filter("start + depth <= bottom")
    at = [*key, "start", "depth"]
    said = F.array_sort(F.collect_list(F.when(F.trim("value") != "", F.struct("row", F.trim("value").alias("v")))))["v"]
    label = tries.filter("row >= start and row < start + depth").groupBy(*at, "left", "right", "col").agg(said.alias("said"))
    parts = F.aggregate("said", F.array().cast("array<string>"), lambda acc, v: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(v), acc).otherwise(F.concat(acc, F.array(v))))
    label = label.withColumn("parts", parts).filter(F.size("parts") > 0).withColumns({"label": F.element_at("parts", -1), "above": F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "path": F.array_join("parts", " / ")})
    n = F.count(F.lit(1))
    levels = F.when(F.col("depth") > 1, F.sum(F.size("above")) / n / F.greatest(F.col("depth") - 1, F.lit(1))).otherwise(0.0)
    labels = label.groupBy(*at, "left", "right").agg(
        (n / (F.col("right") - F.col("left") + 1)).alias("coverage"),
        (F.countDistinct("label") / n).alias("uniqueness"),
        (F.count(F.when(F.col("label").rlike(r"\p{L}"), 1)) / n).alias("text"),
        levels.alias("hierarchy"), n.alias("n_labels"), F.flatten(F.collect_list("above")).alias("above"),
        F.array_sort(F.collect_list(F.struct("col", "path"))).alias("columns"), F.array_sort(F.collect_list(F.struct("col", "label"))).alias("leaves"), F.sum(F.size("parts")).alias("richness"),
    )
    most = F.coalesce(F.array_max(F.transform(F.array_distinct("above"), lambda x: F.size(F.filter("above", lambda y: y == x)))), F.lit(0))
    labels = labels.withColumn("dominance", most / F.col("n_labels"))
    number = F.regexp_replace("value", ",", "").try_cast("double").isNotNull()
    below = tries.filter("row = start + depth and not merged").groupBy(*at).agg((F.count(F.when(number, 1)) / n).alias("contrast"))
    styled = tries.filter("style is not null and not merged and trim(value) <> ''").select(*at, "row", "col", "style")
    last, under = styled.filter("row = start + depth - 1").alias("h"), styled.filter("row >= start + depth and row <= start + depth + 2").alias("b")
    same = last.join(under, [*at, "col"]).groupBy(*at).agg(F.avg((F.col("h.style") == F.col("b.style")).cast("double")).alias("alike"))
    joined = labels.join(below, at, "left").join(same, at, "left").na.fill(0.0, ["contrast"])
    w = WEIGHTS
    score = w["base"] + F.col("coverage") * w["coverage"] + F.col("uniqueness") * w["uniqueness"] + F.col("text") * w["text"] + F.col("contrast") * w["contrast"]
    score += F.col("hierarchy") * (1 - F.least(F.lit(1.0), F.col("dominance"))) * w["hierarchy"] + F.coalesce(1 - F.col("alike"), F.lit(0.0)) * w["style"]
    score += (1 - F.col("text")) * (1 - F.col("contrast")) * w["plain"] + (F.col("depth") - 1) * w["depth"] + F.when(F.col("depth") > 1, F.coalesce("alike", F.lit(0.0))).otherwise(0.0) * w["added"]
    return joined.select(*at, "columns", "leaves", "richness", "dominance", F.greatest(F.lit(0.05), F.least(F.lit(0.98), score)).alias("confidence"))


def best_headers(candidates: DataFrame) -> DataFrame:
    """Of each region the header of the highest confidence, from LEAST on; ties to the first row, then to fewer rows.

    One with the same leaves whose confidence is at most NEAR less, and none of whose upper labels
    stands above more than DOMINANT of its columns, is taken instead if its paths hold more labels.
    """
    key = ["workbook_id", "sheet", "region"]
    able = candidates.filter(F.col("confidence") >= LEAST)
    top = best(able, key, [F.round("confidence", 9).desc(), F.col("start"), F.col("depth")])
    led = able.join(top.select(*key, F.struct("start", "depth", "leaves", "confidence").alias("top")), key)
    is_top = (F.col("start") == F.col("top.start")) & (F.col("depth") == F.col("top.depth"))
    richer = (F.col("confidence") >= F.col("top.confidence") - NEAR) & (F.col("leaves") == F.col("top.leaves")) & (F.col("dominance") <= DOMINANT)
    return best(led.filter(is_top | richer), key, [F.col("richness").desc(), F.round("confidence", 9).desc(), F.col("start"), F.col("depth")]).drop("top")
