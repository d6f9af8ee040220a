"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents;
the last adds the number of the copy. Every stage takes an empty table, nulls in any column,
repeated rows, ids that are null or stand for several texts, and more columns of any name,
which come along. A row is told by its id and its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, jaccard, langid, mixing, substrings
from granary.llm.shared import free_name, saved, scratch, table

SENT = 1_000_000  #: up to so many ids are sent to every task; more are joined by a shuffle


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if they have no letter or no language that half of their words speak for.

    Null and empty texts have no letter. Repeated rows go or stay together. lang, which may be
    null, is learned from and never judged by. Without any lang to learn from nothing stays.
    """
    carry = [c for c in docs.columns if c != "doc_id"]
    found = langid.identify(docs, langid.fit_documents(docs), carry=[c for c in carry])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, nulls last, then that with the smallest text hash.

    Rows that repeat a doc_id with an equal text are one. Texts without words link with nothing
    and stay.
    """
    ids = docs.select("doc_id", text_hash().alias("t"))
    if ids.distinct().count() < ids.count():
        t = free_name("_t", docs)
        docs = docs.withColumn(t, text_hash()).dropDuplicates(["doc_id", t]).drop(t)
    gone = jaccard.superfluous_documents(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash"))
    gone = F.broadcast(gone) if gone.count() <= SENT else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_hash"]), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; a document that loses all its words goes.

    A changed text has its words joined by single spaces, and n_chars follows it; other texts
    and all other columns stay as they are. Null and empty texts lose nothing and stay.
    """
    carry = [c for c in docs.columns if c != "doc_id"]
    found = substrings.dedup_substrings(docs, carry=carry)
    left = found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = left.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    found = decontamination.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = saved(found.filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_hash")).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= SENT else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_hash"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes; a column copy of docs gives way to their number. See mixing.mix."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language identification is learned, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch():  # but for the last, whose rows are still to be read, tables go when the next stage is done
        for i, (name, stage) in enumerate(STAGES[:-1]):
            docs = saved(stage(spark, docs, sf_dir), name, keep=i == len(STAGES) - 2)
    return STAGES[-1][1](spark, docs, sf_dir)
