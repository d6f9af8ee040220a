"""Cells of CSV files of any size, each file read by many tasks.

Spark's text source cuts a file at line ends wherever its byte ranges fall. A line ends a record unless it ends inside
quotes, which hangs on whether it began inside them. Each line is a function of that one bit, and so are
blocks of lines; blocks are put together first, a row each, then the lines within each block. What
a quote means is up to the rules of the csv module: it opens a field only where the field begins.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import written

DELIMITERS = ",;\t|"  # fixed value, in order
HEAD, HEAD_LINES = 65_536, 50  # fixed values: characters and lines that tell the delimiter
CELLS = "path string, row long, col int, value string"


def ends_inside(line: Column, delimiter: Column) -> Column:
    """Whether a line that begins outside quotes ends inside them.

    Closed fields in quotes are taken out from left to right; a quote left where a field begins was never closed.
    """
    d = F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter)
    closed = F.concat(F.lit("(^|"), d, F.lit(')"[^"]*+(?:""[^"]*+)*+"'))
    rest = F.regexp_replace(line, closed, F.lit("$1q"))
    return F.when(F.contains(line, F.lit('"')), F.regexp_like(rest, F.concat(F.lit("(^|"), d, F.lit(')"')))).otherwise(F.lit(False))


def read_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, block, at, line: the lines of the files, blocks by their first byte, lines in order of at; written, so the order is fixed."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return written(raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")))


def decoded(lines: DataFrame) -> DataFrame:
    """lines as text: UTF-8 if a whole file is, else GB18030, which only Python can read. The mark at the begin of a file goes."""
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("utf8"))
    told = lines.join(valid, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(line=[bytes(x).decode("gb18030", "replace") for x in batch["line"]])

    other = told.filter("not utf8").drop("utf8").mapInPandas(run, "path string, block long, at long, line string")
    every = told.filter("utf8").select("path", "block", "at", F.col("line").cast("string").alias("line")).unionByName(other)
    first = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) == 1
    marked = every.withColumn("first", (F.col("block") == 0) & first)
    return marked.select("path", "block", "at", F.when(F.col("first"), F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line"))


def delimiters(lines: DataFrame) -> DataFrame:
    """path, delimiter: with which each of a file's first lines has most columns, then all of them; files without one have no row."""
    order = Window.partitionBy("path", "block").orderBy("at")
    before = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = lines.filter("block = 0").withColumn("before", before).filter(F.col("before") < HEAD).withColumn("line", F.substring("line", F.lit(1), F.lit(HEAD) - F.col("before")))
    head = head.filter(F.trim("line") != "").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEAD_LINES)
    counts = head.select("path", "line", F.posexplode(F.array(*[F.lit(d) for d in DELIMITERS])).alias("i", "delimiter")).withColumn("n", F.length("line") - F.length(F.replace("line", F.col("delimiter"), F.lit(""))))
    told = counts.groupBy("path", "i", "delimiter").agg(F.min("n").alias("least"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("n") > 0, 1)).alias("hold"))
    best = told.groupBy("path").agg(F.max(F.struct("least", "total", -F.col("i"), "delimiter", "lines", "hold")).alias("b"))
    return best.filter("b.lines >= 2 and b.hold >= 2").select("path", "b.delimiter")


def numbered_records(lines: DataFrame) -> DataFrame:
    """lines: path, block, at, line, delimiter. Adds inside (whether the line goes on with the last one's record), open (whether the next does) and row, the record's number from 1."""
    out, in_ = ends_inside(F.col("line"), F.col("delimiter")), ends_inside(F.concat(F.lit('"'), F.col("line")), F.col("delimiter"))
    lines = lines.withColumns({"out": out, "in": in_})
    # A line either keeps the bit, turns it, or sets it.
    sets, turns = F.col("out") == F.col("in"), F.col("out") & ~F.col("in")
    step = lines.withColumn("set", F.when(sets, F.col("out"))).withColumn("turn", turns.cast("int"))

    def state(value: Column, since: Column, before: Column) -> Column:
        """The bit after the last line that set it, and the turns since; without such a line it is what it was before."""
        return (F.coalesce(value, before).cast("int") + since) % 2 == 1

    # Of each block what it does to the bit, then the bit before each block.
    order = Window.partitionBy("path", "block").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn("turns", F.sum("turn").over(order))
    last = F.max_by(F.struct(F.col("set").alias("v"), "turns"), F.when(F.col("set").isNotNull(), F.col("at")))
    block = step.groupBy("path", "block").agg(last.alias("last"), F.sum("turn").alias("all"))
    block = block.select("path", "block", F.col("last.v").alias("v"), (F.col("all") - F.coalesce("last.turns", F.lit(0))).alias("since"))
    files = Window.partitionBy("path").orderBy("block")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    # since counts turns behind the block's own setter; a block without one adds all its turns.
    block = block.withColumn("run", F.sum("since").over(files)).withColumn("mark", F.last(F.when(F.col("v").isNotNull(), F.struct("v", (F.col("run") - F.col("since")).alias("run"))), ignorenulls=True).over(earlier))
    turned = F.coalesce(F.sum("since").over(earlier), F.lit(0)) - F.coalesce("mark.run", F.lit(0))
    block = block.select("path", "block", state(F.col("mark.v"), turned, F.lit(False)).alias("before"))
    met = step.join(block, ["path", "block"])
    mark = F.last(F.when(F.col("set").isNotNull(), F.struct(F.col("set").alias("v"), "turns")), ignorenulls=True).over(upto)
    met = met.withColumn("mark", mark)
    inside = state(F.col("mark.v"), F.coalesce(F.sum("turn").over(upto), F.lit(0)) - F.coalesce("mark.turns", F.lit(0)), F.col("before"))
    met = met.withColumn("inside", inside).withColumn("open", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    begins = (~F.col("inside")).cast("long")
    met = met.withColumn("here", F.sum(begins).over(order))
    total = met.groupBy("path", "block").agg(F.sum(begins).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("path", "block", "offset")
    return met.join(total, ["path", "block"]).select("path", "block", "at", "line", "delimiter", "inside", "open", (F.col("here") + F.col("offset")).alias("row"))


def read_csv(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, row, col, value: the non-empty cells of the CSV files below folder.

    Rows count records, empty lines too. Files in which no delimiter parts two lines have no rows.
    A record is one task's, however many lines it has, and so is what follows a quote that is never closed.
    """
    lines = decoded(read_lines(spark, folder, pattern))
    known = written(numbered_records(lines.join(delimiters(lines), "path")))
    # The last line of a file that ends with a line end is no line; Spark gives none.
    whole = known.filter("not inside and not open").select("path", "row", "delimiter", "line")
    parts = known.filter("inside or open").groupBy("path", "row", "delimiter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("line"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, row, delimiter, line in batch.itertuples(index=False):
                values = [v for r in csv.reader(io.StringIO(line), delimiter=delimiter) for v in r]
                found += [(path, row, c, v) for c, v in enumerate(values, 1) if v != ""]
            yield pd.DataFrame(found, columns=["path", "row", "col", "value"])

    return whole.unionByName(parts).mapInPandas(run, CELLS)
