"""The factors of substring dedup against plain loops."""

import random

import numpy as np
import pytest

from granary.llm import substrings


def index(runs, size):
    start = np.r_[0, np.cumsum([len(r) for r in runs])]
    return substrings.Index(np.array([w for r in runs for w in r], np.uint64), start, size), start


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(40))
def test_longest_factors_and_spans(seed):
    r = random.Random(seed)
    size = r.choice([2, 3, 5, 9])
    base = [r.randrange(r.choice([2, 4, 30])) for _ in range(40)]
    runs = []
    for _ in range(r.randrange(1, 9)):
        run = [r.randrange(4) for _ in range(r.randrange(12))]
        if r.random() < 0.6:
            i = r.randrange(30)
            run[r.randrange(len(run) + 1) :] = base[i : i + r.randrange(20)]
        runs.append(run)
    found, start = index(runs, size)
    places = [(g, i) for g, run in enumerate(runs) for i in range(len(run))]
    want = [max((common(runs[g][i:], runs[h][j:]) for h, j in places if (h, j) != (g, i)), default=0) for g, i in places]
    got = found.longest(np.arange(len(places))).tolist()
    assert got == [min(w, found.most) for w in want] and found.most >= size
    spans = set()
    for g, i, n in zip(*substrings.factors(np.array([w for run in runs for w in run], np.uint64), start, size), strict=True):
        assert n >= size and n == got[start[g] + i]
        spans |= {(g, x) for x in range(i, i + n)}
    windows = {(g, x) for (g, i), w in zip(places, want, strict=True) if w >= size for x in range(i, i + size)}
    assert spans == windows


def test_a_copy_is_one_factor_of_its_whole_length(monkeypatch):
    copied = list(range(100, 160))
    runs = [[1, 2, 3, *copied, 4], [5, *copied, 6, 7], [8, 9]]
    _, start = index(runs, 35)
    words = np.array([w for r in runs for w in r], np.uint64)
    run, at, n = substrings.factors(words, start, 35)
    assert {(0, 3, 60), (1, 1, 60)} <= set(zip(run.tolist(), at.tolist(), n.tolist(), strict=True)) and len(run) == 2
    # Nothing but the factors' lengths, and the windows across their ends, makes a span.
    monkeypatch.setattr(substrings.Index, "longest", lambda self, at: np.zeros(len(at), np.int64))
    assert not len(substrings.factors(words, start, 35)[0])


def test_without_factors_nothing_is_removed(spark, monkeypatch):
    text = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "a " + text), (2, text + " b"), (3, "c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(docs).collect()) == [(1, 60), (2, 60), (3, 0)]
    found = substrings.factors(np.arange(80, dtype=np.uint64) % np.uint64(40), np.array([0, 40, 80]), 35)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(0, 0, 40), (1, 0, 40)]
