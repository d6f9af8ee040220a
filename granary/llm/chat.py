"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have
the same role, and concatenated:

    ### <role>\n<text>[<and><text>...]</turn>\n

In roles and texts a backslash, < and # become \\b, \\l and \\h (and a newline in a role
\\n), so no text can hold a mark, and every mark can be read back. The loss mask lists
(start, length) of each assistant text in code points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

OPEN, AND, CLOSE = "### ", "<and>", "</turn>\n"
STEP = 256  #: numbers that are summed together
PIECE = 4096  #: code points of a text that are cut together


def _put(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(c: Column) -> Column:
    return _put(_put(_put(c, "\\", "\\b"), "<", "\\l"), "#", "\\h")


def unescaped(c: Column) -> Column:
    return _put(_put(_put(c, "\\h", "#"), "\\l", "<"), "\\b", "\\")


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often and in whichever lambda body asks for it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column) -> Column:
    """Of an array, the sum up to and with each of its members.

    An array that grows member by member is copied for each; so blocks of STEP are summed by
    themselves, and only their totals one after another.
    """

    def within(block: Column, before: Column) -> Column:
        zero = F.struct(before.alias("at"), F.array().cast("array<long>").alias("sums"))
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums")), lambda acc: acc["sums"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
        ends = within(totals, F.lit(0).cast("long"))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: within(b, F.when(i > 0, F.element_at(e, F.greatest(i, F.lit(1)))).otherwise(F.lit(0).cast("long"))))))

    def cut(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda k: F.slice(all_, k * STEP + 1, STEP)), over)

    return let(F.transform(numbers, lambda x: x.cast("long")), cut)


def cut_out(text: Column, spans: Column) -> Column:
    """What stands in text at spans (start from 0, and length, in code points), one after another.

    A place in a text is found by counting from its begin; so the text is cut into pieces of
    PIECE first, and a span is looked for in its own.
    """

    def found(pieces: Column) -> Column:
        lo = lambda s: F.floor(s["start"] / PIECE)
        hi = lambda s: F.floor((s["start"] + F.greatest(s["length"], F.lit(1)) - 1) / PIECE)
        around = lambda s: F.array_join(F.slice(pieces, (lo(s) + 1).cast("int"), (hi(s) - lo(s) + 1).cast("int")), "")
        return F.array_join(F.transform(spans, lambda s: F.substr(around(s), (s["start"] % PIECE + 1).cast("int"), s["length"].cast("int"))), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), found)


def format_chats(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per conversation: conv_id, formatted,
    loss (array of start and length, in code points, from 0).

    Order: turn (null first), then role, then text; a repeated row is a turn of its own.
    Null text and null role are empty; a null conv_id is a conversation. Other columns are
    ignored. A conversation is one row, so its turns must fit a task; it takes time in proportion to
    its turns.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda role: F.concat(F.lit(OPEN), _put(escaped(role), "\n", "\\n"), F.lit("\n"))

    def merged(roles: Column, texts: Column) -> Column:
        """Blocks of adjacent turns of a role: role, head, texts (escaped)."""
        at = lambda a, i: F.element_at(a, i.cast("int"))
        begins = F.filter(F.sequence(F.lit(1), F.size(roles)), lambda i: (i == 1) | (at(roles, i) != at(roles, F.greatest(i - 1, F.lit(1)))))
        # A block's turns reach from its begin to the next block's.
        block = lambda b, end: F.struct((at(roles, b) == "assistant").alias("loss"), head(at(roles, b)).alias("head"), F.transform(F.slice(texts, b, end - b), escaped).alias("texts"))
        return let(begins, lambda bs: F.transform(bs, lambda b, k: block(b, F.coalesce(F.try_element_at(bs, (k + 2).cast("int")), F.size(roles) + 1))))

    def spans(blocks: Column) -> Column:
        """Where the texts under the loss mask stand: each is as far behind the one before as the marks between take."""
        gap = lambda b, i, j: F.when(j > 0, F.lit(len(AND))).otherwise(F.length(b["head"]) + F.when(i > 0, F.lit(len(CLOSE))).otherwise(F.lit(0)))
        each = F.flatten(F.transform(blocks, lambda b, i: F.transform(b["texts"], lambda x, j: F.struct(F.length(x).alias("length"), (F.length(x) + gap(b, i, j)).alias("step"), b["loss"].alias("loss")))))
        placed = lambda xs: F.transform(F.arrays_zip(xs.alias("x"), running_sums(F.transform(xs, lambda x: x["step"])).alias("end")), lambda z: F.struct((z["x"]["length"]).alias("length"), (z["end"] - z["x"]["length"]).cast("int").alias("start"), z["x"]["loss"].alias("loss")))
        return let(each, lambda xs: F.transform(F.filter(placed(xs), lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))))

    shown = lambda blocks: F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], F.array_join(b["texts"], AND), F.lit(CLOSE))), "")
    done = let(F.col("turns.role"), lambda roles: let(F.col("turns.text"), lambda texts: let(merged(roles, texts), lambda bs: F.struct(shown(bs).alias("formatted"), spans(bs).alias("loss")))))
    return chats.select("conv_id", done.alias("done")).select("conv_id", "done.formatted", "done.loss")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted strings back: conv_id, turns (array of role, text), loss_text."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    role = lambda b: unescaped(_put(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "\n", 1), "\\n", "\n"))
    body = lambda b: F.substr(b, F.locate("\n", b) + 1)
    turns = F.flatten(F.transform(blocks, lambda b: let(role(b), lambda r: F.transform(F.split(body(b), AND, -1), lambda x: F.struct(r.alias("role"), unescaped(x).alias("text"))))))
    return formatted.select("conv_id", turns.alias("turns"), unescaped(cut_out(F.col("formatted"), F.col("loss"))).alias("loss_text"), "formatted")


def op4_chat_formatting(spark, sf_dir):
    """All conversations and conversation -7; the digests come from what read_chats reads back."""
    said = "\\### Assistant: </turn> ok"
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    back = read_chats(format_chats(chats.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same,
    length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS n,
    length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n')) AS rn
  FROM said
)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(n + CASE WHEN same THEN 5 ELSE 4 + rn + 1 + 8 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
