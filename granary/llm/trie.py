"""Prefix trie of conversations by pointer jumping.

A node is a sequence of turns that conversations begin with, keyed by a digest of it and tied to
its parent's digest. What all nodes below a node sum up to comes in rounds: in round r every node has a
pointer to its ancestor 2**r above it and the sum of the nodes fewer than 2**r below it. Each
hands its sum to that ancestor and takes that ancestor's pointer. So a trie of depth d is
done after about log2(d) rounds, and a round holds only nodes at least 2**r deep.

Turns are numbered and digested in segments, so no task holds a whole conversation; rows that
many others point to are looked up apart from the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, scratch, table

SEGMENT = 512  #: turns that are digested together
CHUNK = 4096  #: consecutive ids that are spelled together
HOT = 1000  #: a key with more than one part in so many of all rows is looked up apart; there are fewer such keys than this
ROOT = bytes(16)


def digest(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said, 256), 1, 32))


def number_turns(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, pos (from 1), digest, n (UTF-8 bytes of the text).

    Order: turn (null first), then digest; a repeated row is a turn of its own. Null role and
    text are empty; rows without a conv_id belong to no conversation and are left out; other
    columns are ignored. Rows are sorted across tasks by conversation and turn, and numbered
    from where the task before has stopped, so one conversation may spread over many.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n"))
    spread = slim.repartitionByRange(F.col("conv_id"), F.col("turn"), F.col("digest"), F.rand(7))  # equal rows may part, too
    dealt = saved(spread.withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("here")).select("conv_id", "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    ranked = dealt.select("conv_id", "part", "digest", "n", F.row_number().over(within).alias("rank"))
    return ranked.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("rank")).cast("long").alias("pos"), "digest", "n")


def looked_up(rows: DataFrame, on: str, known: DataFrame) -> DataFrame:
    """rows left-joined with known (key and more columns; unique keys) where rows[on] is the key.

    Keys that more than one in HOT of all rows ask for, fewer than HOT keys, go to every task.
    """
    total = rows.count()
    hot = F.broadcast(saved(rows.groupBy(on).count().filter(F.col("count") * HOT > total).select(on), "hot"))
    known = known.withColumnRenamed("key", on)
    few = saved(known.join(hot, on, "left_semi"), "known")
    return rows.join(hot, on, "left_semi").join(F.broadcast(few), on, "left").unionByName(rows.join(hot, on, "left_anti").join(known, on, "left"))


def chained(sequences: DataFrame) -> DataFrame:
    """sequences: conv_id, pos, digest, n. Returns conv_id, depth, key, parent, n: a row for each prefix but the empty one.

    Inside a segment a running digest goes from turn to turn. A prefix's key is the digest of
    that and of the key of the prefix that ends where the segment begins; only the latter
    keys, one a segment, are made one after another.
    """
    seg = F.floor((F.col("pos") - 1) / SEGMENT).alias("seg")
    inside = sequences.groupBy("conv_id", seg).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n"))).alias("turns"))
    segments = saved(inside.select("conv_id", "seg", "turns.digest", "turns.n"), "segments")
    kind = sequences.schema["conv_id"].dataType.simpleString()

    def running(digests: list[bytes]) -> Iterator[bytes]:
        at = ROOT
        for d in digests:
            at = hashlib.blake2b(at + d, digest_size=16).digest()
            yield at

    below = lambda carry, local: hashlib.blake2b(carry + local, digest_size=16, person=b"prefix").digest()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [list(running(x))[-1] for x in batch.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seg"), pa.array(last, pa.binary())], ["conv_id", "seg", "total"])

    def carries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, carry = None, ROOT
        for batch in batches:
            out = []
            for c, total in zip(batch.column("conv_id").to_pylist(), batch.column("total").to_pylist(), strict=True):
                carry = below(carry if c == conv else ROOT, total)
                conv = c
                out.append(carry)
            seg = pa.array([s + 1 for s in batch.column("seg").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), seg, pa.array(out, pa.binary())], ["conv_id", "seg", "carry"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "seg", "digest", "n", "carry"]
        for batch in batches:
            conv, depth, key, parent, size = [], [], [], [], []
            for c, seg, digests, n, carry in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                before = carry
                for i, (local, bytes_) in enumerate(zip(running(digests), n, strict=True)):
                    conv.append(c)
                    depth.append(seg * SEGMENT + i + 1)
                    parent.append(before)
                    before = below(carry, local)
                    key.append(before)
                    size.append(bytes_)
            yield pa.RecordBatch.from_arrays([pa.array(conv, batch.column("conv_id").type), pa.array(depth, pa.int64()), pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(size, pa.int64())], ["conv_id", "depth", "key", "parent", "n"])

    full = segments.filter(F.size("digest") == SEGMENT).mapInArrow(totals, f"conv_id {kind}, seg long, total binary")
    told = full.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(carries, f"conv_id {kind}, seg long, carry binary")
    first = segments.filter("seg = 0").withColumn("carry", F.lit(bytearray(ROOT)))
    later = segments.filter("seg > 0").join(told, ["conv_id", "seg"])
    return first.unionByName(later).mapInArrow(prefixes, f"conv_id {kind}, depth long, key binary, parent binary, n long")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes: key, parent (null: root), depth and the columns sums. Returns key and sums over each node's subtree.

    Rows per round r: nodes of depth 2**r or more.
    """
    state = nodes.filter("depth > 0").select("key", "depth", F.col("parent").alias("up"), *sums)
    gains, step = [], 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        state = saved(state, "pointers")
        gain = saved(state.groupBy(F.col("up").alias("key")).agg(*[F.sum(c).alias(c) for c in sums]), "gains")
        gains.append(gain)
        if step * 2 <= deepest:
            more = gain.select("key", *[F.col(c).alias(f"more_{c}") for c in sums])
            # Nodes that are as deep as the next step go on; their ancestors' pointers lead there.
            left = state.filter(F.col("depth") >= 2 * step).join(more, "key", "left").select("key", "depth", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])
            jumps = state.select("key", F.col("up").alias("next"))
            state = looked_up(saved(left, "left"), "up", jumps).select("key", "depth", F.col("next").alias("up"), *sums)
        step *= 2
    own = nodes.select("key", *sums)
    for gain in gains:
        own = own.unionByName(gain)
    return own.groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])


def spelled_ends(ends: DataFrame) -> DataFrame:
    """ends: key, conv_id (distinct). Returns key, ends_sha256: of the ascending ids, comma-joined.

    Ids are spelled in ranges of at most CHUNK ids; a key's ranges then pass one task in order,
    one at a time, since a digest of the whole is asked for.
    """
    chunks = ends.groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda done: pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])
        now, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield made(done)
        if now is not None:
            yield made([(now, state.hexdigest())])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences, a row each.

    sequences: conv_id, pos (from 1, without gaps), digest, n (bytes), as number_turns gives
    them; convs: conv_id, distinct, all conversations, turnless ones too; none is null.
    Returns key and parent (digests; the root's parent is null), conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty
    table of conversations has no nodes, and so no root.
    """
    with scratch():
        kind = convs.schema["conv_id"].dataType
        none = F.lit(None).cast("binary")
        root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("key"), none.alias("parent"), F.lit(0).cast("long").alias("n"))
        prefixes = saved(root.unionByName(chained(sequences)), "prefixes")
        # Depth, parent and bytes hang on the key.
        found = prefixes.groupBy("key", "parent", "depth", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        found = saved(found, "found")
        children = found.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = found.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n"))
        nodes = saved(nodes, "nodes")
        sums = rolled_up(nodes, ["n_leaves", "saved_tokens"])
        last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last")).select("conv_id", "last.key")
        named = looked_up(saved(nodes.select("key", "parent"), "edges"), "parent", nodes.select("key", F.col("conv_id").alias("parent_conv_id"))).select("key", "parent_conv_id")
        told = nodes.drop("n", "n_leaves", "saved_tokens").join(sums, "key").join(named, "key").join(spelled_ends(last), "key", "left")
        return saved(
            told.select(
                "key", "parent", F.col("conv_id").cast(kind), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
            ),
            "trie", keep=True,
        )


def spliced(numbered: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences in which conversation c begins as c - c % every does: sequences and convs for prefix_trie.

    numbered: as number_turns gives it. The first h turns, h = crc32(c) % most, are that
    conversation's (all if it has fewer, none if there is none), and c's own follow from h + 1 on.
    Turns meet their conversation's splice by conversation and segment.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n_turns")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    convs = saved(convs, "convs")
    first = numbered.filter((F.col("pos") < most) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n"))).alias("turns"))
    heads = convs.join(first, "base", "left").select("conv_id", "n_turns", "h", F.slice(F.coalesce("turns", F.array().cast("array<struct<pos:long,digest:binary,n:long>>")), F.lit(1), F.col("h").cast("int")).alias("turns"))
    heads = saved(heads, "heads")
    begun = heads.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.pos", "t.digest", "t.n")
    seg = lambda pos: F.floor((pos - 1) / SEGMENT)
    shift = heads.select("conv_id", "h", (F.size("turns") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), seg(F.col("n_turns")))).alias("seg"))
    own = numbered.withColumn("seg", seg(F.col("pos"))).join(shift, ["conv_id", "seg"]).filter("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "n")
    return begun.unionByName(own), convs.select("conv_id")


def op13_prefix_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    with scratch():
        nodes = prefix_trie(*spliced(saved(number_turns(turns), "numbered")))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP13_SQL = """
WITH t AS (
  SELECT conv_id, turn, sha256(octet_length(encode(COALESCE(role, '')))::VARCHAR || ':' || COALESCE(role, '') || COALESCE(text, '')) AS d, octet_length(encode(COALESCE(text, '')))::BIGINT AS n
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, d) AS l FROM t GROUP BY conv_id
), c AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM s
), r AS (
  SELECT c.conv_id, list_concat(COALESCE(b.l[1:c.h], []), c.l[c.h + 1:]) AS q FROM c LEFT JOIN s b ON b.conv_id = c.conv_id - c.conv_id % 5
), p AS (
  SELECT conv_id, d, len(q) AS turns, CASE WHEN d > 0 THEN q[d].n ELSE 0 END AS n, md5(array_to_string(list_transform(q[1:d], lambda x: x.d), ',')) AS k,
    CASE WHEN d > 0 THEN md5(array_to_string(list_transform(q[1:d - 1], lambda x: x.d), ',')) END AS up
  FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM r)
), node AS (
  SELECT d, k, up, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * MIN(n) AS saved,
    sha256(COALESCE(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends
  FROM p GROUP BY d, k, up
), kids AS (
  SELECT d - 1 AS d, up AS k, COUNT(*) AS n_children FROM node WHERE d > 0 GROUP BY d, up
), own AS (
  SELECT node.*, COALESCE(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)
), total AS (
  SELECT a.d, a.k, SUM((o.n_children = 0)::INT) AS n_leaves, SUM(o.saved) AS saved_tokens FROM own o JOIN p a ON a.conv_id = o.conv_id AND a.d <= o.d GROUP BY a.d, a.k
)
SELECT o.conv_id, o.d AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN total USING (d, k) LEFT JOIN own u ON u.d = o.d - 1 AND u.k = o.up
"""
