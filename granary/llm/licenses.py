"""License scans by ordered signature rules, in DataFrame operations only.

Texts are cut into words. A place is looked at if its word, or its word and the next, begins some
rule; the letters that a rule must hold are looked for before its regular expression is tried
on the words that follow. A detection goes if one of as low a level holds its words; equal
places go to the lower level, then to the earlier rule. Detections of base rules stay.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontamination import words
from .license_rules import SCORES, Rule, rules
from .shared import saved, scratch, table

WIDTH = 64  #: words that a rule may span


@cache
def standard_rules() -> tuple[Rule, ...]:
    return tuple(rules())


def rule_table(spark, of: tuple[Rule, ...]) -> DataFrame:
    """A row for each rule and opening: as many as the rules, which are written by hand, have."""
    rows = [{"opening": opening, "rule": i, "label": r.label, "level": r.level, "base": r.base, "need": r.need, "regex": f"^(?:{r.regex}) "} for i, r in enumerate(of) for opening in r.openings]
    kind = "array<struct<opening:string,rule:int,label:string,level:int,base:boolean,need:string,regex:string>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def looked_at(docs: DataFrame, of: tuple[Rule, ...]) -> DataFrame:
    """row, doc_id, n_words, places (array of pos, first, pair, said: the words from there on, each with a space after it)."""
    openings = {o for r in of for o in r.openings}
    singles, firsts = sorted(o for o in openings if " " not in o), sorted({o.split(" ")[0] for o in openings})
    pairs = sorted(o for o in openings if " " in o)
    cut = docs.select("doc_id", words(F.col("text")).alias("w"))
    pair = lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.coalesce(F.try_element_at("w", i + 1), F.lit("")))
    begins = lambda x, i: F.when(x.isin(firsts) & (x.isin(singles) | pair(i + 1).isin(pairs)), i + 1)
    at = F.filter(F.transform("w", begins), lambda i: i.isNotNull())
    place = lambda i: F.struct((i - 1).cast("long").alias("pos"), F.element_at("w", i).alias("first"), pair(i).alias("pair"), F.concat(F.array_join(F.slice("w", i, WIDTH), " "), F.lit(" ")).alias("said"))
    return cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), F.transform(at, place).alias("places"))


def detections(places: DataFrame, known: DataFrame) -> DataFrame:
    """places: as looked_at gives them. Returns row, start, end (words), rule, label, level, base: all that match."""
    each = places.select("row", F.inline("places"))
    keyed = each.select("row", "pos", "said", F.explode(F.array_distinct(F.array("first", "pair"))).alias("opening"))
    tried = keyed.join(F.broadcast(known), "opening").filter(F.contains("said", "need"))
    found = tried.withColumn("match", F.expr("regexp_extract(said, regex, 0)")).filter("match <> ''")
    end = F.col("pos") + F.length("match") - F.length(F.replace("match", F.lit(" "), F.lit("")))
    return found.select("row", F.col("pos").alias("start"), end.cast("long").alias("end"), "rule", "label", "level", "base").distinct()


def kept(found: DataFrame, levels: int) -> DataFrame:
    """found without the detections that one before them of no higher level holds; base ones stay.

    Holders begin no later, so in order of start, longest first, a running maximum of the ends of
    each level tells whether there is one.
    """
    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("level") <= i, F.col("end"))).over(order).alias(f"reach_{i}") for i in range(levels)]
    told = found.select("*", *reach)
    held = F.coalesce(F.element_at(F.array(*[f"reach_{i}" for i in range(levels)]), F.col("level") + 1) >= F.col("end"), F.lit(False))
    return told.withColumn("held", held).filter(F.col("base") | ~F.col("held")).drop(*[f"reach_{i}" for i in range(levels)])


def scan_licenses(docs: DataFrame, of: tuple[Rule, ...] | None = None, scores: dict[int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row for each row of docs, and one for each detection that stays.

    docs: doc_id, text. The first has row, doc_id, n_words; the second row, start, end, rule, label,
    level, base, held (a base detection that another holds) and score. row ties them and changes from
    run to run. Null and empty texts have no words and no detections; repeated rows are scanned
    each; a null doc_id stays; other columns are ignored. A text is held by one task.
    """
    of, scores = of or standard_rules(), scores or SCORES
    too_wide = [r.regex for r in of if r.regex.count(" ") >= WIDTH]
    if too_wide:
        raise ValueError(f"a rule may span {WIDTH} words: {too_wide[0]}")
    places = saved(looked_at(docs, of), "places", keep=True)
    found = detections(places, rule_table(docs.sparkSession, of))
    score = F.element_at(F.create_map(*[F.lit(x) for item in scores.items() for x in item]), F.col("level"))
    return places.select("row", "doc_id", "n_words"), kept(found, max(scores) + 1).withColumn("score", score)


def op12_license_scan(spark, sf_dir):
    with scratch():
        rows, found = scan_licenses(table(spark, sf_dir, "documents"))
        joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
        base = F.col("base")
        told = found.groupBy("row").agg(
            F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"),
        )
        told = saved(told, "told", keep=True)
    none = F.lit("")
    return rows.join(told, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ",\n".join(f"({quoted(o)}, {i}, {quoted(r.label)}, {r.level}, {r.base}, {quoted(f'^(?:{r.regex}) ')})" for i, r in enumerate(standard_rules()) for o in r.openings)
    score = " ".join(f"WHEN {level} THEN {x}" for level, x in SCORES.items())
    return rf"""
WITH rules(opening, rule, label, level, base, regex) AS (VALUES {known}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0
), o AS (
  SELECT r, i, w, w[i] AS opening FROM p UNION ALL SELECT r, i, w, w[i] || ' ' || w[i + 1] FROM p WHERE i < len(w)
), t AS (
  SELECT DISTINCT r, i - 1 AS start, rule, label, level, base, regexp_extract(array_to_string(w[i:i + {WIDTH - 1}], ' ') || ' ', regex) AS said FROM o JOIN rules USING (opening)
), m AS (
  SELECT r, start, start + length(said) - length(replace(said, ' ', '')) AS stop, rule, label, level, base FROM t WHERE said <> ''
), k AS (
  SELECT * FROM m WHERE base OR NOT EXISTS (
    SELECT 1 FROM m h WHERE h.r = m.r AND h.start <= m.start AND h.stop >= m.stop AND h.level <= m.level
      AND (h.start < m.start OR h.stop > m.stop OR (h.level, h.rule) < (m.level, m.rule))
  )
), a AS (
  SELECT r, COUNT(*) FILTER (base) AS n_base, MIN(start) FILTER (base) AS first_word, MAX(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, MAX(CASE level {score} END)::DOUBLE AS score
  FROM k GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0) AS score
FROM d LEFT JOIN a USING (r)
"""


OP12_SQL = _sql()
