"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import chat, decontamination, jaccard, langid, mixing, quality, substrings, tokens, topk, toxicity

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [
    None, "", "   ", "one", "one", "One two", "a b c d e f g h i j k l", "漢字 かな ñandú É é", LONG, "x" * 50_000,
    " ".join(f"p{i}" for i in range(60)) + " tail", "head " + " ".join(f"p{i}" for i in range(60)), "same " * 80, "\t a\x0b\x0cb\r\nc \x00 d", "a b c",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key long, n long, token long, count long, words string, rate double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, 3, 4, 5, 6, "w", 0.5) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, "s1"), (None, "no id here", None, None), (7, "another text of id seven", "de", "s2"), (3, "one", None, "s1")]
    return table(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def test_tokens(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path).collect())
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    assert got == want
    assert tokens.count_tokens(empty, path).count() == 0


def test_merges_match_the_library_on_random_texts():
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, merges, r = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Merges(path), random.Random(4)
    texts = ["".join(r.choice("abcdeiorst  .,\n\tßé漢😀▁<s>01\x00") for _ in range(r.randint(0, 50))) for _ in range(3000)] + ["ab" * 400, "a" * 999, " " * 99]
    assert merges.of_texts(pa.array(texts)).tolist() == [len(model.encode(t)) for t in texts]


@pytest.mark.parametrize("long", [1, tokens.LONG])
def test_long_pre_tokens_match_the_library(monkeypatch, long):
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    monkeypatch.setattr(tokens, "LONG", long)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, merges, r = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Merges(path), random.Random(9)
    parts = [["a", "ab", "the", "ing", "==", "-", "0", "1"], list("ACGT"), list("abcdefghijklmnopqrstuvwxyz"), list("あいうえおかき漢字"), ["a"], ["="]]
    texts = ["".join(r.choice(p) for _ in range(n)) for p in parts for n in (*range(1, 60), 300, 5000)] + ["x" * 1_000_000, "".join(r.choice(parts[2]) for _ in range(1_000_000))]
    assert merges.of_texts(pa.array(texts)).tolist() == [len(model.encode(t)) for t in texts]


def brute_spans(texts, size):
    seen = Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings(docs, hot):
    rows = docs.collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, *b) for r, b in zip(rows, brute_spans([r.text for r in rows], 35), strict=True))
    got = substrings.dedup_substrings(docs, hot=hot).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_substrings_on_random_texts(spark, empty):
    r = random.Random(8)
    parts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(r.randint(5, 60))) for _ in range(30)]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(120)] + ["x y " * 50, "x y " * 40 + "z"]
    df = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    for hot in (substrings.HOT, 10):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == brute_spans(texts, 35)
    assert substrings.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("block", [1, 400, substrings.BLOCK])
@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings_where_an_anchor_repeats_and_no_window_does(spark, monkeypatch, block, hot):
    """Texts that share 20 words: their runs meet in one block and have no factor; others have some."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    common = [" ".join(f"c{k}x{i}" for i in range(20)) for k in range(3)]
    texts = [" ".join(f"d{i}y{j}" for j in range(40)) + " " + common[i % 2] + " " + " ".join(f"e{i}y{j}" for j in range(40)) for i in range(7)]
    for more in ([], [texts[0]], [common[2] * 2, common[2]]):
        rows = texts + more
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(table(spark, [(i, t, None, None) for i, t in enumerate(rows)]), hot=hot).collect()}
        assert [got[i] for i in range(len(rows))] == brute_spans(rows, 35)


def brute_components(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        c = find(i)
        if d is not None and (least[c] is None or d < least[c]):
            least[c] = d
    return sorted(((d is None, d or 0, len(sets[i]), (least[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.similar_documents(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert jaccard.similar_documents(empty).count() == 0


@pytest.mark.parametrize(("seed", "percent", "dense"), [(1, 90, 16), (2, 90, 2), (3, 80, 2)])
def test_jaccard_on_families_of_near_copies(spark, monkeypatch, seed, percent, dense):
    """Families whose members are near the threshold, above and below it, so that stars, gray pairs and members all occur."""
    monkeypatch.setattr(jaccard, "DENSE", dense)
    if dense == 2:  # pairs of one node in several parts, one deputy a star, tokens dealt to several parts, ids joined by shuffles
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 5)
        monkeypatch.setattr(jaccard, "DEPUTIES", 1)
        monkeypatch.setattr(jaccard, "MEET", 5)
        monkeypatch.setattr(jaccard, "BEFORE", seed - 1)
        monkeypatch.setattr(jaccard, "SENT", 0)
        monkeypatch.setattr(jaccard, "CONTRACTIONS", seed - 2)
    r = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"f{family}w{r.randint(0, 400)}" for _ in range(r.choice([12, 60, 150, 200]))]
        for _ in range(45):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 28))):
                w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.similar_documents(table(spark, [(i, t, None, None) for i, t in rows]), percent=percent).collect()
    assert sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, percent)


def test_components_of_paths_stars_and_cycles(spark):
    """A path's labels must not need a round a hop; node ids are random."""
    r = random.Random(6)
    ids = r.sample(range(-(10**9), 10**9), 3000)
    path, cycle, star = ids[:1000], ids[1000:1500], ids[1500:]
    edges = list(zip(path, path[1:], strict=False)) + list(zip(cycle, cycle[1:] + cycle[:1], strict=True)) + [(star[0], x) for x in star[1:]] + [(path[0], path[0]), (path[1], path[0])]
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((x.node, x.label) for x in got) == sorted((x, min(group)) for group in (path, cycle, star) for x in group)
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_on_a_chain_of_a_thousand_texts(spark):
    """Each text links to the next only: 94 of 102 shingles in common, with the one after that 90 of 106."""
    r = random.Random(7)
    ids = r.sample(range(10, 10**6), 1000)
    rows = [(i, " ".join(f"c{w}" for w in range(4 * k, 4 * k + 100)), None, None) for k, i in enumerate(ids)] + [(1, " ".join(f"x{w}" for w in range(100)), None, None)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_documents(table(spark, rows)).collect()}
    assert got == {i: (98, min(ids)) for i in ids} | {1: (98, 1)}


def test_chat(spark):
    said = [(1, 0, "user", "hi <and> \\h # </turn>\n### x"), (1, 1, "assistant", "a</turn>\\l"), (1, 1, "assistant", "b<"), (1, 2, None, None), (None, None, "assistant", ""), (2, 5, "assistant", "漢\\"), (2, 5, "assistant", "漢\\"), (2, 1, "ro\nle#", "t")]
    df = spark.createDataFrame([(*x, 1, "z") for x in said], "conv_id long, turn long, role string, text string, loss int, formatted string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv in (1, 2, None):
        turns = sorted((x for x in said if x[0] == conv), key=order)
        assert [tuple(t) for t in back[conv].turns] == [(x[2] or "", x[3] or "") for x in turns]
        assert back[conv].loss_text == "".join(x[3] or "" for x in turns if x[2] == "assistant")
    assert back[1].formatted.count("### ") == 3  # the two assistant turns share a block
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing(docs, empty):
    plan = mixing.plan_mix(docs).collect()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    target, open_, left = {}, set(names), total
    while True:  # share, cap, share what is over again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
            left -= 3 * size[s]
    target |= share if not over else {}
    for r in plan:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies and r.copies in (int(r.rate), int(r.rate) + 1) and r.copies <= 3
    assert sum({r.source: r.target for r in plan}.values()) == pytest.approx(total)
    copies = mixing.mix(docs)
    assert copies.count() == sum(r.copies for r in plan) and copies.columns == [*docs.columns, "copy"]
    assert sorted(r.taken for r in mixing.plan_mix(docs.repartition(5)).collect()) == sorted(r.taken for r in plan)
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, named = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        out.append((d is None, d or 0, len(w), len(hit), sorted(named)))
    return sorted(out)


@pytest.mark.parametrize("sent", [decontamination.SENT, 0])
def test_decontamination(spark, docs, empty, monkeypatch, sent):
    monkeypatch.setattr(decontamination, "SENT", sent)
    items = [(1, "P0 p1, p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"), (2, "one"), (3, None), (4, " .. "), (None, "two"), (1, "ñandú É é"), (5, "same same same same same same same same same same"), (6, "a b c d e f g h i j"), (6, "a b c d e f g h i j")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = decontamination.contamination(docs, bench)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == brute_hits([(r.doc_id, r.text) for r in docs.collect()], items)
    assert got.filter("contaminated <> (n_hit > 0)").count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "zero alpha beta gamma x delta"), (2, "alpha beta gamma delta"), (3, "alpha far away from what the item says delta")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    near = {(r.doc_id, r.exact) for r in decontamination.find_phrases(decontamination.split_texts(d), b, size=4, lists=2, slop=2).collect()}
    assert (2, True) in near and all(not e for i, e in near if i == 1) and not any(i == 3 for i, _ in near)


def test_one_index_serves_phrases_and_proximity_of_any_items(spark):
    r = random.Random(3)
    vocabulary = "abcdefgh"
    d = [(i % 25 if i % 7 else None, " ".join(r.choice(vocabulary) for _ in range(r.randrange(30)))) for i in range(60)] + [(3, "a b c d")] * 2
    docs = spark.createDataFrame(d, "doc_id long, text string")
    split = decontamination.split_texts(docs)
    index = decontamination.build_index(split)
    lists = {(x.doc_id, x.text_hash, x.term): x.positions for x in index.collect()}
    held = {(x.doc_id, x.text_hash): x.words for x in split.collect()}
    assert lists == {(*k, t): [i for i, w in enumerate(ws) if w == t] for k, ws in held.items() for t in set(ws)}
    for n_items, slop in ((4, 0), (6, 2)):
        items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 6)))) for i in range(n_items)]
        b = spark.createDataFrame(items, "item_id long, text string")
        rows = [decontamination.find_phrases(split, b, size=3, slop=slop, index=x).collect() for x in (index, None)]
        assert Counter(map(tuple, rows[0])) == Counter(map(tuple, rows[1]))
        windows = {tuple(w[i : i + 3]) for _, t in items for w in [t.split()] for i in range(max(len(w) - 2, 1))}
        want = {(k, i, len(w)) for k, ws in held.items() for w in windows for i in range(len(ws)) if tuple(ws[i : i + len(w)]) == w}
        got = [x for x in rows[0] if x.exact]
        assert {((x.doc_id, x.text_hash), x.start, x.n) for x in got} == want and len(got) == len({(x.doc_id, x.text_hash, x.win_id, x.start) for x in got})


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.randint(-9, 9) for _ in range(6)]) for i in range(400)] + [(1000 + i, [3] * 6) for i in range(30)] + [(5, [99] * 6), (None, [1] * 6), (7000, None), (8000, [1, 2]), (8001, [5, 5])]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "vec_id long, vector array<long>, rank int, block int, score long")
    vectors = [(i, v) for i, v in rows if i is not None and v is not None]
    for block, batch in ((8192, 4096), (50, 3)):
        got = defaultdict(list)
        for x in sorted(topk.top_k(df.filter("vec_id % 10 = 0"), df, 4, block, batch).collect(), key=lambda x: (x.query_id, x.rank)):
            got[x.query_id].append((x.vec_id, x.score))
        for q in {i for i, _ in vectors if i % 10 == 0}:
            want = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for j, own in vectors if j == q for i, v in vectors if i != q and len(v) == len(own))[:4]
            assert got[q] == [(i, -s) for s, i in want]
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_repeated_ids_are_rows_as_in_the_sql(spark, tmp_path):
    r = random.Random(9)
    rows = [(i % 40 if i % 3 else 100 * (i % 4), [r.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(1, [0.5] * 4)] * 30
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    got = topk.op1_top_k_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(topk.OP1_SQL).fetchall())


def test_vectors_with_holes_and_large_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [-0.0001, 3.0], "x"), (100, [1.0, 1.0], "x"), (None, [1.0, 2.0], "x"), (6, [1e6, -1e6], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    vectors = topk.whole_vectors(df)
    assert {r.vec_id: r.vector for r in vectors.collect()} == {0: [512, -256], 5: [-1, 3072], 100: [1024, 1024], None: [1024, 2048], 6: [1024 * 10**6, -1024 * 10**6]}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, 2).collect()}
    large = 512 * 1024 * 10**6 + 256 * 1024 * 10**6
    assert got == {(0, 1): (6, large), (0, 2): (100, 512 * 1024 - 256 * 1024), (100, 1): (5, 1024 * 3071), (100, 2): (0, 1024 * 256)}
    for huge in (1e30, 3e6 * 1024):
        rows = spark.createDataFrame([(0, [huge, 1.0]), (1, [huge, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(topk.whole_vectors(rows), topk.whole_vectors(rows))
    exact = spark.createDataFrame([(0, [2**30, 1]), (1, [2**30, 2]), (2, [2**30, 1])], "vec_id long, vector array<long>")
    assert [(r.vec_id, r.score) for r in topk.top_k(exact.filter("vec_id = 0"), exact).collect()] == [(1, 2**60 + 2), (2, 2**60 + 1)]


def test_mixing_again_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}", 1, 2, 3, 4, 5) for i in range(30)], "doc_id long, text string, source string, copy int, _copies int, _rate int, _source int, Rate int")
    once = mixing.mix(docs)
    assert once.columns == ["doc_id", "text", "source", "_copies", "_rate", "_source", "Rate", "copy"]
    assert {tuple(r)[3:7] for r in once.collect()} == {(2, 3, 4, 5)}
    assert mixing.mix(once).columns == once.columns


@pytest.mark.parametrize("same_text", [False, True])
def test_rows_without_or_with_equal_ids_draw_each(spark, tmp_path, same_text):
    rows = [(None if i % 2 else 7, "a b c" if same_text else f"a b c{i}", "s1") for i in range(600)] + [(i, "x " * 21, "s2") for i in range(150)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    plan = mixing.plan_mix(docs).collect()
    for source in ("s1", "s2"):
        own = [r for r in plan if r.source == source]
        rate, n = own[0].rate, len(own)
        part = rate - int(rate)
        assert abs(sum(r.copies for r in own) - rate * n) <= 4 * (n * part * (1 - part)) ** 0.5
    spread = lambda rows: Counter((r.doc_id, r.size, r.taken) for r in rows)
    assert spread(plan) == spread(mixing.plan_mix(docs.repartition(3)).collect())
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    key = lambda x: str(x[0]) + str(x[1:])
    assert sorted(con.execute(mixing.OP7_SQL).fetchall(), key=key) == sorted(map(tuple, mixing.op7_mixing(spark, str(tmp_path)).collect()), key=key)


def test_chat_with_many_turns(spark):
    said = [(1, i, ("user", "assistant")[i // 7 % 2], f"t{i}<") for i in range(3000)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).first()
    assert [tuple(t) for t in back.turns] == [x[2:] for x in said] and back.loss_text == "".join(x[3] for x in said if x[2] == "assistant")


def test_one_conversation_of_100_000_turns_takes_time_linear_in_turns(spark):
    times = []
    for n in (50_000, 100_000):
        said = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 14 < 7, 'user', 'assistant') as role", "concat('t', id, '<') as text")
        began = time.time()
        back = chat.read_chats(chat.format_chats(said)).selectExpr("size(turns) as n", "length(loss_text) as loss").first()
        times.append(time.time() - began)
        assert back.n == n and back.loss == sum(len(f"t{i}<") for i in range(n) if i % 14 >= 7)
    assert times[1] < 30


def test_learned_operators_take_anything(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(12)] + [(None, 1, 1), (2, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for model, score in ((quality.fit(docs, labels), quality.score), (quality.fit(empty, labels), quality.score), (quality.fit(docs, labels.limit(0)), quality.score), (toxicity.fit(docs, labels), toxicity.score), (toxicity.fit(empty, labels), toxicity.score)):
        got = score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert score(empty, model).count() == 0
    for known in (docs, empty):
        model = langid.fit_documents(known)
        got = langid.identify(docs, model).collect()
        text = {r.doc_id: r.text for r in docs.collect()}
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.lang_pred == "und" for r in got if r.doc_id not in (3, 7) and not re.search(r"[^\W\d_]", text[r.doc_id] or ""))
    assert langid.identify(empty, model).count() == 0
