"""The prefix trie against a plain dictionary of prefixes, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from granary.llm import trie


def plain(rows):
    """rows: conv_id, turn, role, text. The contract's rows, sorted."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0, d), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, q in rebuilt.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        own_saved = (len(m) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += own_saved
    ends = lambda n, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], ends(n, m)) for n, m in list(members.items()))


def sample(seed, n=60, long=0):
    r = random.Random(seed)
    rows = []
    for c in [*range(-7, n), *([1000 + i for i in range(12)])]:
        if r.random() < 0.1:
            continue
        for t in range(r.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, r.choice([t, t, t, None, t // 2]), r.choice(["user", "assistant", None]), r.choice(["", None, "a", "é", "bb"])))
    for c in (1000, 1005, 1006, 1007):
        rows += [(c, t, "user", "same" if t < long - 3 else f"{t}{c}") for t in range(long)]
    rows += [(None, 0, "user", "lost"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, pos long, n long"


@pytest.mark.parametrize("segment, hot, chunk, long", [(512, 1000, 4096, 40), (4, 5, 3, 70)])
def test_nodes_match_a_dictionary_and_the_sql(spark, tmp_path, monkeypatch, segment, hot, chunk, long):
    for name, value in (("SEGMENT", segment), ("HOT", hot), ("CHUNK", chunk)):
        monkeypatch.setattr(trie, name, value)
    rows = sample(segment, long=long)
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5).write.parquet(path)
    got = sorted(tuple(r) for r in trie.op13_prefix_trie(spark, str(tmp_path)).collect())
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(trie.OP13_SQL).fetchall()) == got


def test_no_conversations_no_nodes(spark, tmp_path):
    spark.createDataFrame([(None, 1, "a", "b", "x", 1, 2)], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_a_path_takes_a_logarithm_of_rounds(spark, monkeypatch):
    found = []
    real = trie.saved
    monkeypatch.setattr(trie, "saved", lambda df, name, keep=False: found.append(name) or real(df, name, keep))
    turns = spark.createDataFrame([(1, t, "user", str(t)) for t in range(100)], "conv_id long, turn long, role string, text string")
    numbered = trie.number_turns(turns)
    nodes = trie.prefix_trie(numbered, numbered.select("conv_id").distinct())
    assert found.count("gains") == 7
    assert {(r.depth, r.n_leaves) for r in nodes.collect()} == {(d, 1) for d in range(101)}
