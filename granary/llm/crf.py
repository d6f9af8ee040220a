"""A linear-chain conditional random field over words, in numpy.

A word's features are its own hash, its character 3- and 4-grams with the word's ends
marked (so prefixes and suffixes are among them), and the lexicons that list it. The
emission score of a label is the sum of its weights over a word's features; transitions
are learned too. Chains have at most CHAIN words; longer texts are cut into chains.
Forward and backward passes run over all chains of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import U, hashes, mixed

CHAIN = 128
AT_ONCE = 2048  #: chains whose marginals are computed together
BITS = 18  #: log2 of the feature table's rows


WORDS = 1 << 16  #: whose features are made at once


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray, lexicon: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words data[s:e] as one ragged array, and where each begins.

    lexicon: sorted word hashes; lists: rows of a word's place there, ascending, and the number
    of a lexicon that lists it.
    """
    made = [_features(data, s[i : i + WORDS].astype(np.int64), e[i : i + WORDS].astype(np.int64), lexicon, lists) for i in range(0, len(s), WORDS)]
    size = np.concatenate([np.zeros(1, np.int64), *(np.diff(start) for _, start in made)])
    return np.concatenate([np.zeros(0, np.int32), *(f for f, _ in made)]), np.cumsum(size)


def _features(data: np.ndarray, s: np.ndarray, e: np.ndarray, lexicon: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = e - s + 2
    start = np.r_[0, np.cumsum(n)]
    flat = np.empty(start[-1], np.uint64)
    pos = np.arange(start[-1]) - np.repeat(start[:-1], n)
    body = (pos > 0) & (pos < np.repeat(n, n) - 1)
    flat[body] = data[(np.repeat(s, n) + pos - 1)[body]]
    flat[start[:-1]], flat[start[1:] - 1] = 256, 257
    word = np.repeat(np.arange(len(s)), n)
    parts, owners = [], []
    for k in (3, 4):
        m = max(0, len(flat) - k + 1)
        at = np.flatnonzero(word[:m] == word[k - 1 :][:m]) if m else np.zeros(0, np.int64)
        g = np.full(len(at), k, np.uint64)
        for i in range(k):
            g = g * U(521) + flat[at + i]
        parts.append(mixed(g) >> U(64 - BITS))
        owners.append(word[at])
    up = np.argsort(s)
    own = np.empty(len(s), np.uint64)
    own[up] = hashes(data, s[up], e[up])
    parts.append(mixed(own) >> U(64 - BITS))
    owners.append(np.arange(len(s)))
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, own), len(lexicon) - 1)
        begin = np.searchsorted(lists[:, 0], np.arange(len(lexicon) + 1))
        n = np.where(lexicon[at] == own, begin[at + 1] - begin[at], 0)
        which = np.arange(n.sum()) + np.repeat(begin[at] - (np.cumsum(n) - n), n)
        parts.append(lists[which, 1].astype(np.uint64))
        owners.append(np.repeat(np.arange(len(s)), n))
    feature, owner = np.concatenate(parts).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return feature[order], np.searchsorted(owner[order], np.arange(len(s) + 1))


@dataclass
class CRF:
    labels: list
    weights: np.ndarray  # features x labels
    trans: np.ndarray  # from x to
    first: np.ndarray
    lexicon: np.ndarray
    lists: np.ndarray

    def emissions(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.empty((len(s), len(self.labels)), np.float32)
        for i in range(0, len(s), WORDS):
            f, start = features(data, s[i : i + WORDS], e[i : i + WORDS], self.lexicon, self.lists)
            out[i : i + WORDS] = np.add.reduceat(self.weights[f], start[:-1], axis=0) / np.sqrt(np.diff(start))[:, None].astype(np.float32)
        return out

    def marginals(self, em: np.ndarray, word: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Marginals of each token. em: of the distinct words; word: of each token, its word; starts: where chains begin, ascending, from 0.

        Some thousand chains at once, so that what is held beside the result stays small.
        """
        out = [np.zeros((0, len(self.labels)))]
        ends = np.r_[starts[1:], len(word)]
        for i in range(0, len(starts), AT_ONCE):
            own = starts[i : i + AT_ONCE]
            out.append(forward_backward(em[word[own[0] : ends[min(i + AT_ONCE, len(starts)) - 1]]], own - own[0], self.trans, self.first)[0])
        return np.concatenate(out)


def chain_starts(owner: np.ndarray) -> np.ndarray:
    """Where chains begin if words have these owners: at each new one, and after CHAIN words."""
    if not len(owner):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    n = np.diff(np.r_[first, len(owner)])
    return np.flatnonzero((np.arange(len(owner)) - np.repeat(first, n)) % CHAIN == 0)


def forward_backward(em: np.ndarray, starts: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label marginals of each word and, with pairs, the expected transitions."""
    n, k = em.shape
    if not n:
        return np.zeros((0, k)), None
    length = np.diff(np.r_[starts, n])
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    t_max = int(length[0])
    x = np.exp(em - em.max(axis=1, keepdims=True)).astype(np.float64)
    step, begin = np.exp(trans), np.exp(first)
    alive = np.searchsorted(-length, -np.arange(1, t_max + 1), side="right")  # chains with a word t
    alpha = np.empty((n, k))
    now = None
    for t in range(t_max):
        at = starts[: alive[t]] + t
        now = x[at] * (begin if t == 0 else now[: alive[t]] @ step)
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    out = np.empty((n, k))
    expected = np.zeros((k, k)) if pairs else None
    beta = np.ones((len(starts), k))
    for t in range(t_max - 1, -1, -1):
        at = starts[: alive[t]] + t
        m = alpha[at] * beta[: alive[t]]
        m /= m.sum(axis=1, keepdims=True)
        out[at] = m
        if t:
            back = x[at] * beta[: alive[t]]
            if pairs:
                joint = alpha[at - 1][:, :, None] * step[None] * back[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            new = back @ step.T
            beta[: alive[t]] = new / new.max(axis=1, keepdims=True)
    return out, expected


def train(labels: list, data: np.ndarray, s: np.ndarray, e: np.ndarray, word: np.ndarray, tag: np.ndarray, starts: np.ndarray, lexicon: np.ndarray, lists: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.25, decay: float = 1e-6, seed: int = 5) -> CRF:
    """Fit by AdaGrad on batches of chains.

    data[s:e]: distinct words; word: of each token, its word; tag: its label; starts: where
    chains begin.
    """
    k, f_all, f_start = len(labels), *features(data, s, e, lexicon, lists)
    scale = 1 / np.sqrt(np.diff(f_start))
    w, trans, first = np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    gw, gt, gf = np.full((1 << BITS, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    rng = np.random.default_rng(seed)
    ends = np.r_[starts[1:], len(word)]
    for _ in range(epochs):
        shuffled = rng.permutation(len(starts))
        for i in range(0, len(starts), batch):
            chosen = shuffled[i : i + batch]
            n = ends[chosen] - starts[chosen]
            own = np.r_[0, np.cumsum(n)[:-1]]
            at = np.arange(n.sum()) - np.repeat(own - starts[chosen], n)
            uw, back = np.unique(word[at], return_inverse=True)
            reps = np.diff(f_start)[uw]
            seg = np.r_[0, np.cumsum(reps)]
            feat = f_all[np.arange(seg[-1]) - np.repeat(seg[:-1] - f_start[uw], reps)]
            em = (np.add.reduceat(w[feat], seg[:-1], axis=0) * scale[uw][:, None])[back]
            m, expected = forward_backward(em, own, trans, first, pairs=True)
            y = tag[at]
            m[np.arange(len(y)), y] -= 1
            g_word = np.stack([np.bincount(back, m[:, j], len(uw)) for j in range(k)], 1) * scale[uw][:, None]
            used, fb = np.unique(feat, return_inverse=True)
            per_feature = np.repeat(g_word, reps, axis=0)
            g = np.stack([np.bincount(fb, per_feature[:, j], len(used)) for j in range(k)], 1).astype(np.float32) / len(chosen)
            gw[used] += g * g
            w[used] -= rate * (g / np.sqrt(gw[used]) + decay * w[used])
            inner = np.ones(len(y), bool)
            inner[own] = False
            seen = np.bincount(y[np.flatnonzero(inner) - 1] * k + y[inner], minlength=k * k).reshape(k, k)
            g_t, g_f = (expected - seen) / len(chosen), m[own].sum(axis=0) / len(chosen)
            gt += g_t * g_t
            gf += g_f * g_f
            trans -= rate * g_t / np.sqrt(gt)
            first -= rate * g_f / np.sqrt(gf)
    return CRF(labels, w, trans, first, lexicon, lists)
