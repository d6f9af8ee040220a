"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their smoothed class counts, and a
linear model is fitted to the scaled indicators by dual coordinate descent on the hinge
loss. N-grams are words and pairs of words, and up to three neighbouring word shapes (runs
of lower case, upper case and digits as one sign each, other signs as they are, and a sign
of its own for a word that repeats the one before). A logistic curve turns margins of
rows left out of the fit into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import SAMPLE_BYTES, held_out
from .shared import table
from .toxicity import logistic, sample_labelled
from .words import _BASE, _CODE, _UNBASE, LOWER, NOT_BLANK, U, grams, hashes, mixed, pieces, powers, spans, text_bytes

BITS = 20  #: log2 of the number of features


def _kinds() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[0x80:0xA0], kind[0xA0:0xC0], kind[0xC0:] = 2, 1, 0  # Latin-1 letters in UTF-8; lead bytes say nothing
    return kind


_KIND = _kinds()


def shapes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word's shape; s and e ascend."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + (1 << 20))))
        lo, hi = int(s[i]), int(e[j - 1])
        kind = _KIND[data[lo:hi]]
        keep = kind > 0
        keep[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] > 3)
        keep[s[i:j] - lo] = True
        n = np.r_[0, np.cumsum(keep)]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(np.where(keep, _CODE[kind] * powers(_BASE, hi - lo + 1)[n[:-1]], U(0)), out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (total[b] - total[a]) * powers(_UNBASE, hi - lo + 1)[n[a]]
        i = j
    return mixed(out + U(1))


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text: text numbers, ascending, and features."""
    data, off = text_bytes(texts)
    s, e, owner = spans(data, off, NOT_BLANK)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, shape = hashes(LOWER[data], s, e), shapes(data, s, e)
    again = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
    shape[again] = U(99)
    keys = []
    for n, base in ((1, word), (2, word), (1, shape), (2, shape), (3, shape)):
        h, at = grams(base, owner, n)
        keys.append((owner[at] << BITS) | (mixed(h + U(n * 2 + (base is shape))) >> U(64 - BITS)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # ratio times the fitted weight
    bias: float
    curve: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, f = indicators(texts)
        n = len(texts)
        norm = np.sqrt(np.bincount(row, self.ratio[f].astype(np.float64) ** 2, n))
        margin = np.bincount(row, self.weight[f], n) / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30)))


def dual_descent(start: np.ndarray, f: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, c: float = 4.0, epochs: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of least hinge loss; row i is f[start[i]:start[i + 1]] with its values and y in -1, 1."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = np.add.reduceat(np.r_[value**2, 0], np.minimum(start[:-1], len(value))) * (np.diff(start) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at = slice(start[i], start[i + 1])
            g = y[i] * (w[f[at]] @ value[at] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f[at]] += step * value[at]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, smooth: float = 1.0, most_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: doc_id, text; labels: doc_id and label (0 or 1). Learns from a bounded sample of labelled rows.

    The sample has at most `most` rows and most_bytes of text (see within_bytes). Without
    labels of both kinds every text gets one score: 0.5, or near 0 or 1. Null texts are empty;
    repeated rows count again; ties in hash go by id.
    """
    rows = sample_labelled(docs, labels, label, most, most_bytes)
    y = np.array([r[1] for r in rows], np.int64)
    size = 1 << BITS
    if not y.any() or y.all():
        sure = 0.0 if not len(y) else (3.0 if y.all() else -3.0)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, np.array([sure, 0.0]))
    found = [indicators(pa.array([r[2] for r in rows[i : i + 200]], pa.large_string())) for i in range(0, len(rows), 200)]
    row = np.concatenate([x[0].astype(np.int32) + 200 * i for i, x in enumerate(found)])
    f = np.concatenate([x[1].astype(np.int32) for x in found])
    del found
    left = np.arange(len(y)) % 5 == 0  # gives the curve only
    count = [np.bincount(f[((y == k) & ~left)[row]], minlength=size) + smooth for k in (0, 1)]
    ratio = (np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())).astype(np.float32)
    ratio[(count[0] + count[1]) <= 2 * smooth] = 0  # never seen: says nothing
    value = ratio[f]
    norm = np.sqrt(np.bincount(row, value**2, len(y)))
    value /= np.maximum(norm, 1e-9)[row].astype(np.float32)
    start = np.searchsorted(row, np.arange(len(y) + 1))
    use = np.flatnonzero(~left)
    picked = np.concatenate([np.arange(start[i], start[i + 1]) for i in use])
    own = np.r_[0, np.cumsum(start[use + 1] - start[use])]
    w, bias = dual_descent(own, f[picked], value[picked], 2.0 * y[use] - 1, size)
    margin = np.bincount(row, w[f] * value, len(y)) + bias
    shown = left if 0 < y[left].sum() < left.sum() else np.ones(len(y), bool)
    curve = logistic(np.stack([np.ones(shown.sum()), margin[shown]], 1), y[shown], 1e-1)
    return Model(ratio, (w * ratio).astype(np.float32), float(bias), curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and score (0 to 1, higher: label 1 likelier).

    Null and empty texts have no n-grams and the score of the bias. Repeated rows and null
    ids stay; a doc_id may have any type; other columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(told.value.scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
