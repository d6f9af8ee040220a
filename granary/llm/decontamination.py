"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Test items are cut into windows of consecutive words, each looked up by its rarest terms. The index is a
stored table: of each of these terms and each document that holds it, the positions where it
stands. Lists, less the terms' offsets in the window, are intersected: a window may stand where
all of them agree on the start. What stands in all lists up to a slop is a proximity match, and an exact
phrase if the document's words from the start on are the window's, which is checked in the
documents that are left. Which items a window is of is joined last, to what was hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENT = 32 << 20  #: up to about so many bytes are sent to every task; more are joined by a shuffle
SALTS = 32  #: parts of a frequent term's postings where terms are joined by a shuffle


def words(text: Column) -> Column:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z; null: none."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def _fits(df: DataFrame, size: Column) -> bool:
    """Whether df may be sent to every task; size: the bytes of a row, about."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= SENT


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item, win_id, win (the words), n of every window of every item; items are strings, null is empty.

    An item of fewer words than size, but not none, is one window.
    """
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = cut.select("item", "w", F.explode(starts).alias("at")).select("item", F.expr(f"slice(w, at, {size})").alias("win")).distinct()
    return each.select("item", F.xxhash64("win").alias("win_id"), "win", F.size("win").alias("n"))


def by_term(postings: DataFrame, keyed: DataFrame) -> DataFrame:
    """postings joined with keyed by term; a term with many postings is dealt to several tasks."""
    if _fits(keyed, F.octet_length("term") + 64):
        return postings.join(F.broadcast(keyed), "term")
    salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def build_index(split: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The positional index: term, doc_id, text_hash, positions (ascending), stored.

    terms: term, those that are indexed; without it all are. A list is one document's, so a frequent
    term's lists are dealt to many tasks. Rows that repeat an id and a text are one document.
    """
    postings = split.dropDuplicates(["doc_id", "text_hash"]) if terms is None else split
    postings = postings.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        postings = by_term(postings, terms.select("term").distinct())
    return saved(postings.groupBy("term", "doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "index")


def rarest_terms(windows: DataFrame, split: DataFrame, lists: int) -> DataFrame:
    """windows (win, ...) with keys: the offsets and terms of their rarest terms in split, rarest first.

    Terms are counted over all documents. Ties go to the lesser term, then the first offset.
    """
    vocabulary = windows.select(F.explode("win").alias("term")).distinct()
    said = split.select(F.explode("words").alias("term"))
    said = said.join(F.broadcast(vocabulary), "term") if _fits(vocabulary, F.octet_length("term") + 32) else said
    counted = said.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = windows.select("win", F.posexplode("win").alias("offset", "term")).join(counted, "term", "left")
    rank = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset")
    keys = placed.groupBy("win").agg(F.slice(F.sort_array(F.collect_list(rank)), 1, lists).alias("keys"))
    return windows.join(keys, "win")


def split_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, words: the texts are cut once and read again as often as needed."""
    return saved(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("words")), "words")


def find_windows(split: DataFrame, windows: DataFrame, lists: int = 2, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Occurrences of windows: doc_id, text_hash, win_id, start (word, from 0), n, exact.

    split: see split_texts; windows: win_id, win, n, distinct, as item_windows has them. index: see
    build_index, made of the windows' rarest terms if it isn't there; one of all terms serves any windows. With slop 0
    rows are exact phrases; with more, the rarest terms may stand up to slop words off, and exact
    tells phrases from proximity; a start before the first word, by up to slop, is possible for
    those. text_hash parts rows that share a doc_id. Windows that no document holds have no rows.
    """
    windows = saved(rarest_terms(windows, split, lists), "windows")
    keyed = windows.select("win_id", F.size("keys").alias("lists"), F.posexplode("keys").alias("list", "key")).select("win_id", "lists", "list", "key.offset", "key.term")
    same = ["doc_id", "text_hash", "win_id"]
    index = build_index(split, keyed) if index is None else index
    met = by_term(index, keyed).select(*same, "lists", "list", F.explode("positions").alias("pos"), "offset")
    places = met.select(*same, "lists", "list", (F.col("pos") - F.col("offset")).alias("start")).filter(F.col("start") >= -slop)
    if slop == 0:  # equal adjusted positions meet in a grouping, which begins before the shuffle
        met = places.groupBy(*same, "start").agg(F.bit_or(F.expr("shiftleft(1L, list)")).alias("seen"), F.first("lists").alias("lists"))
        agreed = met.filter(F.bit_count("seen") == F.col("lists")).select(*same, "start")
    else:
        first = places.filter("list = 0").select(*same, "lists", "start").distinct().alias("f")
        rest = places.filter("list > 0").select(*same, "list", F.col("start").alias("other")).alias("r")
        near = F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.text_hash") == F.col("r.text_hash")) & (F.col("f.win_id") == F.col("r.win_id")) & (F.abs(F.col("start") - F.col("other")) <= slop)
        both = first.join(rest, near, "left").select("f.doc_id", "f.text_hash", "f.win_id", "lists", "start", "list")
        agreed = both.groupBy(*same, "start").agg(F.first("lists").alias("lists"), F.countDistinct("list").alias("agreed")).filter("agreed = lists - 1").select(*same, "start")
    agreed = saved(agreed, "agreed")
    told = F.broadcast(agreed) if _fits(agreed, F.lit(128)) else agreed
    told = told.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    # Rows that repeat an id and a text are one document here.
    text = split.join(told, split["doc_id"].eqNullSafe(told["d"]) & (split["text_hash"] == told["t"])).select(*same, "start", "words")
    shown = windows.select("win_id", "win", "n")
    shown = F.broadcast(shown) if _fits(shown, 64 + F.aggregate("win", F.lit(0), lambda n, w: n + F.octet_length(w) + 24)) else shown
    exact = (F.col("start") >= 0) & (F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("n")) == F.col("win"))
    found = text.join(shown, "win_id").select(*same, "start", "n", exact.alias("exact"))
    return (found if slop else found.filter("exact")).dropDuplicates([*same, "start"])


def find_phrases(split: DataFrame, items: DataFrame, size: int = 10, lists: int = 2, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Occurrences of the items' windows, see find_windows; items: item_id, text."""
    return find_windows(split, item_windows(items, size).select("win_id", "win", "n").dropDuplicates(["win_id"]), lists, slop, index)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, items (sorted ids), contaminated.

    n_hit counts the words inside any exact occurrence. Null text has no words; a null doc_id
    is an id; rows that repeat an id are told apart by their texts, and exact repeats get the
    same result each. An empty table of items hits nothing. Other columns are ignored.
    """
    with scratch():
        split = split_texts(docs)
        sized = saved(split.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words")), "sizes", keep=True)
        every = saved(item_windows(items, size), "items")
        found = saved(find_windows(split, every.select("win_id", "win", "n").dropDuplicates(["win_id"])), "phrases", keep=True)
        # A window of many items meets them once for each document that holds it.
        of_window = every.select("win_id", "item")
        of_window = F.broadcast(of_window) if _fits(of_window, 48 + F.octet_length("item")) else of_window
        named = found.select("doc_id", "text_hash", "win_id").distinct().join(of_window, "win_id").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
        named = saved(named, "named", keep=True)
    key = ["doc_id", "text_hash"]
    upto = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select(*key, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(upto), F.lit(0))))
    hits = spans.withColumn("new", covered).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))
    per_doc = hits.join(named.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "t"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).select(F.col("d"), F.col("t"), "n_hit", "items")
    full = sized.join(per_doc, sized["doc_id"].eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    return full.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def op10_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, GREATEST(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d
), sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT p.doc_id, p.i, win.n, win.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos, sizes WHERE i + n - 1 <= len(w)) p
  JOIN win ON win.win = p.s AND win.n = p.n
), hit AS (
  SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
