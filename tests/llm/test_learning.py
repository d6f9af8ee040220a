"""What the learned operators learn, on generated texts with known labels."""

import random

import itertools

import numpy as np

from granary.llm import crf, langid, quality, toxicity

WORDS = {"aa": ["lorem", "dolor", "ipsum", "sita", "amet"], "bb": ["quick", "brown", "fox", "jumps", "over"]}


def test_language_of_words_in_switched_text(spark):
    import pyarrow as pa

    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS[l]) for _ in range(40)), l) for i, l in enumerate(["aa", "bb"] * 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    share = langid.text_scores(model, pa.array(["lorem dolor ipsum sita " * 6 + "quick brown fox jumps " * 2, "fox over jumps"]))
    assert 0.65 < share[0][0] < 0.85 and share[1][1] > 0.9


def test_toxic_spans_and_scores(spark):
    r = random.Random(3)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(30), r.choice(["scumbag", "idiotish"]))
        rows.append((i, "é " + " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs.filter("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.7) == bool(y) for i, y in labels)
    for i in (300, 305, 310):
        found = [rows[i][1][s.start : s.end] for s in got[i].spans]
        assert found and all("scumbag" in f or "idiotish" in f for f in found)


def test_quality_of_held_out_texts(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
        good = i % 4 != 0
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs.filter("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels[300:])


def test_forward_backward_against_enumeration(monkeypatch):
    r = np.random.default_rng(1)
    for k in (2, 3):
        lengths = [1, 4, 2, 5]
        em, trans, first = r.normal(size=(sum(lengths), k)) * 2, r.normal(size=(k, k)), r.normal(size=k)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        got, pairs = crf.forward_backward(em, starts, trans, first, pairs=True)
        want, want_pairs = np.zeros_like(em), np.zeros((k, k))
        for s, n in zip(starts, lengths, strict=True):
            paths = list(itertools.product(range(k), repeat=n))
            p = np.exp([first[y[0]] + sum(em[s + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)) for y in paths])
            for y, q in zip(paths, p / p.sum(), strict=True):
                for i in range(n):
                    want[s + i, y[i]] += q
                    if i:
                        want_pairs[y[i - 1], y[i]] += q
        assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
        model = crf.CRF(list("abc")[:k], np.zeros((1, k)), trans, first, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
        for at_once in (1, 3, 100):
            monkeypatch.setattr(crf, "AT_ONCE", at_once)
            assert np.allclose(model.marginals(em[::-1], np.arange(len(em))[::-1], starts), want)


def test_dual_descent_reaches_the_least_hinge_loss():
    """Against a plain subgradient method on the same objective; the descent stops at steps below 1e-3."""
    r = np.random.default_rng(2)
    n, size, c = 80, 12, 0.5
    rows = [np.sort(r.choice(size, r.integers(0, 6), replace=False)) for _ in range(n)]
    f, start = np.concatenate(rows).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in rows])]
    value, y = r.normal(size=len(f)), r.choice([-1.0, 1.0], n)
    w, bias = quality.dual_descent(start, f, value, y, size, c=c, epochs=3000)
    x = np.zeros((n, size + 1))
    x[np.repeat(np.arange(n), np.diff(start)), f], x[:, -1] = value, 1.0
    full = np.r_[w, bias]
    primal = lambda v: v @ v / 2 + c * np.maximum(0, 1 - y * (x @ v)).sum()
    v = np.zeros(size + 1)
    for i in range(200_000):
        v -= 1 / (i + 10) * (v - c * ((y * (x @ v) < 1) * y) @ x)
    assert primal(full) <= primal(v) * 1.002
    assert all(primal(full) <= primal(full + 0.1 * r.normal(size=size + 1)) for _ in range(50))


def test_suspicious_words_against_counting():
    r = np.random.default_rng(3)
    unit, owner, y = r.integers(0, 40, 3000).astype(np.uint64), np.sort(r.integers(0, 200, 3000)), (np.arange(200) % 4 == 0).astype(np.int64)
    unit[(y[owner] == 0) & (unit == 7)] = 8
    got = toxicity.suspicious(unit, owner, y)
    for u in range(40):
        docs = {int(d) for d in owner[unit == u]}
        n, share, base = len(docs), sum(y[d] for d in docs) / len(docs), y.mean()
        share = min(max(share, 1e-9), 1 - 1e-9)
        kl = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
        assert set(got[unit == u]) <= {share > max(0.6, base) and n * kl > np.log(40) + 6}
    assert got[unit == 7].all()


def test_offsets_are_code_points_of_whole_texts(spark):
    """Spans under a model that marks a known word, among characters of two to four bytes, in a long text."""
    text = "漢字 é😀 bad " * 300 + "ñ good"
    model = toxicity.Model(crf.CRF(["clean", "toxic"], np.zeros((1 << crf.BITS, 2), np.float32), np.zeros((2, 2)), np.array([0.0, -9.0]), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)), np.array([0.0, 1.0, 1.0]))
    data = np.frombuffer(b"bad", np.uint8)
    f, _ = crf.features(data, np.array([0]), np.array([3]), model.crf.lexicon, model.crf.lists)
    model.crf.weights[f, 1] = 30.0
    model.crf.first[:] = 0.0
    model.crf.weights[:, 0] = 3.0
    got = toxicity.score(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), model)
    spans = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in got.collect()}
    at = [i for i in range(len(text)) if text.startswith("bad", i)]
    assert spans == {1: [(i, i + 3) for i in at], 2: [], 3: []}


def test_many_languages(spark):
    """More lexicons than an integer has bits."""
    r = random.Random(5)
    names = [f"l{i:02}" for i in range(70)]
    vocabulary = {l: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for l in names}
    rows = [(i, " ".join(r.choice(vocabulary[l]) for _ in range(30)), l) for i, l in enumerate(names * 6)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = langid.fit(known)
    got = {x.doc_id: x.lang_pred for x in langid.identify(known, model).collect()}
    assert model.labels == names and sum(got[i] == l for i, _, l in rows) >= 0.95 * len(rows)


def test_long_texts_train_from_all_their_parts_and_bytes_are_bounded(spark):
    rows = [(i, " ".join(WORDS[l] * 40 + [f"{l}zz"] * 200), l) for i, l in enumerate(["aa", "bb"] * 4)]
    known = spark.createDataFrame([*rows, (99, "q " * 200_000, "aa")], "doc_id long, text string, label string")
    model = langid.fit(known, most_bytes=100_000)
    assert len(langid.sample_texts(known, 250, 100_000)) == 8
    assert [x.lang_pred for x in langid.identify(spark.createDataFrame([(1, "aazz aazz aazz"), (2, "bbzz bbzz")], "doc_id long, text string"), model).orderBy("doc_id").collect()] == ["aa", "bb"]
