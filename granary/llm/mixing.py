"""Mixing sources to target weights.

Tokens (here: words) are summed per source, every source gets a target, and the
target divided by the source's size is the source's repetition rate. A document is
emitted floor(rate) times, and once more when a hash of the seed, its id, its text and its number among
rows with the same source, id and text falls below the fraction of the rate. Reruns agree
because nothing but ids, texts and sums decide: which of equal rows has which number changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, free_name, saved, table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """sizes: source, source_size, one row a source. Adds target.

    Sources in order of code points, null last, take the weights in turn. Together
    they share the sum of all sizes; a target stops at cap times its source's size
    and the rest is shared again by weight. In order of cap / weight the capped
    sources come first, so running sums give the level at which sharing ends.
    A source of size 0 has target 0. An empty table gives an empty table. The table of
    sources is one task's: a row a source, of which there must be few, as for any list of weights.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * cap
    by_ratio = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    ranked = (
        sizes.withColumn("weight", pick.cast("long"))
        .withColumn("full", full)
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("full") * F.col("open") <= F.col("left") * F.col("weight"))
    )
    level = ranked.withColumn("rest", F.min(F.when(~F.col("capped"), F.struct(-F.col("open"), F.col("left")))).over(everyone))
    shared = F.col("weight") * F.col("rest.left") / (-F.col("rest.col1"))
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("full").cast("double")).otherwise(shared).alias("target"))


def _rates(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("rate"))


def _copies(rate: str, number: str, seed: int) -> Column:
    """floor(rate), and one more if the draw falls below the fraction."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))), F.lit(":"), F.col(number).cast("string"))
    draw = F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("int")).cast("int")


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """docs with a column number, from 0, among rows with the same source, doc_id and text.

    Only rows that repeat another's are sorted, and a task numbers those that it holds from
    where the ones before have stopped; so a third of all rows may be equal.
    """
    names = [free_name(c, docs) for c in ("_k0", "_k1", "_k2")]
    keyed = docs.withColumns(dict(zip(names, [F.col("source"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))], strict=True)))
    repeated = keyed.groupBy(*names).count().filter("count > 1").drop("count")
    if repeated.isEmpty():
        return docs.withColumn(number, F.lit(0).cast("long"))
    repeated = saved(repeated, "repeated").toDF("_r0", "_r1", "_r2")
    same = lambda other: keyed[names[0]].eqNullSafe(other["_r0"]) & keyed[names[1]].eqNullSafe(other["_r1"]) & (keyed[names[2]] == other["_r2"])
    part, rank = free_name("_part", docs), free_name("_rank", docs)
    some = saved(keyed.join(repeated, same(repeated), "left_semi").withColumn(part, F.shiftright(F.monotonically_increasing_id(), 33)), "equal")
    before = Window.partitionBy("_r0", "_r1", "_r2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], F.col(part).alias("_part")).agg(F.count(F.lit(1)).alias("_here"))
    offsets = counts.select("_r0", "_r1", "_r2", "_part", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_offset"))
    ranked = some.withColumn(rank, F.row_number().over(Window.partitionBy(*names, part).orderBy(F.lit(1))) - 1)
    at = ranked[names[0]].eqNullSafe(offsets["_r0"]) & ranked[names[1]].eqNullSafe(offsets["_r1"]) & (ranked[names[2]] == offsets["_r2"]) & (ranked[part] == offsets["_part"])
    told = ranked.join(offsets, at).select(*[ranked[c] for c in docs.columns], (ranked[rank] + offsets["_offset"]).cast("long").alias(number))
    return keyed.join(repeated, same(repeated), "left_anti").select(*docs.columns, F.lit(0).cast("long").alias(number)).unionByName(told)


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    Null text has size 0; null sources form one source; rows that repeat a doc_id, and those
    without one, are documents of their own that draw each for themselves.
    """
    number = "_number"
    sized = numbered(docs.select("doc_id", "source", "text"), number).select("doc_id", "source", "text", number, word_count(F.col("text")).alias("size"))
    rates = _rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    return (
        sized.join(rates, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", _copies("rate", number, seed))
        .drop("_source", "text", number)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """The copies that the mix takes, as rows: the columns of docs, and copy (from 1).

    A column copy that docs already has, as an earlier mix leaves, gives way to the new one.
    Nulls, repeated rows and empty tables are as in plan_mix; a document of no words has size 0
    and is taken at its source's rate like any other.
    Only the sources' rates are computed from all texts; the texts themselves meet them in
    a join with as many rows as there are sources.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    docs = docs.drop("copy")
    source, rate, copies, number = (free_name(c, docs) for c in ("_source", "_rate", "_copies", "_number"))
    rates = _rates(sized, weights, cap).select(F.col("_source").alias(source), F.col("rate").alias(rate))
    joined = numbered(docs, number).join(rates, F.col("source").eqNullSafe(F.col(source)), "left").withColumn(copies, _copies(rate, number, seed)).filter(F.col(copies) > 0)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns, "copy")


def op7_mixing(spark, sf_dir):
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(COALESCE(text, '')) AS h, row_number() OVER (PARTITION BY source, doc_id, COALESCE(text, '')) - 1 AS number,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM src
), r AS (
  SELECT *, 3 * source_size AS cap, SUM(source_size) OVER ()
    - COALESCE(SUM(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    SUM(weight) OVER ()
    - COALESCE(SUM(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM w
), f AS (SELECT *, cap * open <= room * weight AS capped FROM r),
lvl AS (SELECT room AS lroom, open AS lopen FROM f WHERE NOT capped ORDER BY open DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * lroom)::DOUBLE / lopen::DOUBLE END AS target
  FROM f LEFT JOIN lvl ON TRUE
), d AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, '') || ':' || h || ':' || number), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM d
"""
