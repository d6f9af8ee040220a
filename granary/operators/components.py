"""Connected components as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written


def roots_of(parent: DataFrame) -> DataFrame:
    """parent: node, up, without loops. Returns node, up: the end of each node's way, by pointers that double."""
    at = written(parent)
    while True:
        above = at.select(F.col("node").alias("up"), F.col("up").alias("top"))
        met = written(at.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        at = met.select("node", "up")
        if met.filter("moved").isEmpty():
            return at


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node; edges: a, b. Returns node, label: the least node of its component.

    Each node hooks on to its least neighbour if that is less than itself; trees are flattened, and edges go
    on between their roots. Every tree has two nodes at least, so rounds are few, and edges never grow in number.
    """
    label = nodes.select("node", F.col("node").alias("label"))
    both = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = written(both(edges))
    while not edges.isEmpty():
        hooked = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        root = roots_of(hooked)
        to = root.select(F.col("node").alias("label"), F.col("up").alias("root"))
        label = written(label.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        a, b = root.select(F.col("node").alias("a"), F.col("up").alias("ra")), root.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = written(both(edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    # A root is the least of its tree, as every way leads down.
    return label
