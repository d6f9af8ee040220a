"""Toxic spans and scores with a linear-chain conditional random field.

Labels come per document; the tokens of the training sample are labelled from them: a word
(or its first few bytes) whose documents are toxic far more often than chance allows is
toxic where it stands in a toxic document. The chain model learns these tags from affixes, n-grams and the words
themselves. Forward-backward marginals give the offending offsets, and through a logistic
curve of their maximum and their sum the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import BITS, CRF, chain_starts, train
from .langid import SAMPLE_BYTES, _fold, held_out, within_bytes
from .shared import table
from .words import byte_set, hashes, pieces, spans, text_bytes

#: letters and digits of ASCII, and every byte of longer characters
INSIDE = byte_set(range(48, 58), range(65, 91), range(97, 123), range(128, 256))


@dataclass
class Model:
    crf: CRF
    curve: np.ndarray  # of 1, the largest marginal's log-odds, log(1 + sum of marginals)

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts; start and end byte, text and marginal of each word."""
        raw, off = text_bytes(texts)
        data = _fold(raw)
        s, e, owner = spans(data, off, INSIDE)
        p = np.zeros(len(s))
        if len(s):
            _, at, back = np.unique(hashes(data, s, e), return_index=True, return_inverse=True)
            p = self.crf.marginals(self.crf.emissions(data, s[at], e[at]), back, chain_starts(owner))[:, 1]
        return 1 / (1 + np.exp(-(evidence(p, owner, len(texts)) @ self.curve))), s - off[owner], e - off[owner], owner, p


def evidence(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    top = np.clip(top, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(np.bincount(owner, np.where(p > 0.05, p, 0), n))], 1)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most so many labelled rows, those whose ids hash lowest: (doc_id, label, text).

    labels: doc_id and the label's column. Only this sample reaches the driver. A doc_id with
    several labels has the highest; labels that are null, and ids that are, take no part.
    """
    ids = labels.select("doc_id", F.col(label).alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))  # at most `most` ids
    return within_bytes(chosen, "label", most, most_bytes)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; ridge keeps the weights of separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - q) - ridge * w)
    return w


def suspicious(unit: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tokens' units stand in toxic documents more than chance allows.

    The probability of so large a share of toxic documents is at most exp(-n KL(share, base)),
    which is held against the number of units that were tried.
    """
    distinct, back = np.unique(unit, return_inverse=True)
    pairs = back * len(y) + owner
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    n = np.bincount(pairs // len(y), minlength=len(distinct))
    pairs = pairs[y[pairs % len(y)] == 1]
    bad = np.bincount(pairs // len(y), minlength=len(distinct))
    base, share = y.mean(), np.clip(bad / n, 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    return ((share > max(0.6, base)) & (surprise > np.log(len(distinct)) + 6))[back]


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, seed: int = 3, most_bytes: int = SAMPLE_BYTES, held: float = 0.25) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from a bounded sample of labelled rows.

    The sample has at most `most` rows and most_bytes of text (see within_bytes). A part of its
    rows, held, is kept from the chain model and fits the curve, unless those have labels of
    one kind only; then all rows fit both. All chains of the other rows train.
    Without labels of both kinds, or without a suspicious word, every text gets one low score.
    Null texts are empty; repeated rows count again; ties in hash go by id.
    """
    rows = sample_labelled(docs, labels, "toxic", most, most_bytes)
    n_rows, y = len(rows), np.array([r[1] for r in rows], np.int64)
    blank = CRF(["clean", "toxic"], np.zeros((1 << BITS, 2), np.float32), np.zeros((2, 2)), np.array([0.0, -9.0]), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    none = Model(blank, np.array([-3.0, 0.0, 0.0]))
    if not y.any() or y.all():
        return none
    # The driver holds the whole sample: numbers are kept short, and what has been used goes.
    raw, off = text_bytes(pa.array([r[2] for r in rows], pa.large_string()))
    del rows
    data = _fold(raw)
    del raw
    s, e, owner = (x.astype(np.int32) for x in spans(data, off, INSIDE))
    distinct, at, word = np.unique(hashes(data, s, e), return_index=True, return_inverse=True)
    del distinct
    word = word.astype(np.int32)
    tag = np.zeros(len(s), np.int8)
    for k in (None, 4, 5, 6):  # whole words, and prefixes of so many bytes
        use = np.arange(len(s), dtype=np.int32) if k is None else np.flatnonzero(e - s > k).astype(np.int32)
        if len(use):
            tag[use] |= suspicious(hashes(data, s[use], e[use] if k is None else s[use] + k), owner[use], y)
    tag &= y[owner].astype(np.int8)
    if not tag.any():
        return none
    rng = np.random.default_rng(seed)
    apart = rng.permutation(n_rows) < held * n_rows
    if len(set(y[apart])) < 2 or not tag[~apart[owner]].any():
        apart = np.zeros(n_rows, bool)
    starts = chain_starts(owner)
    ends = np.r_[starts[1:], len(word)]
    chosen = np.flatnonzero(~apart[owner[starts]])
    flat = np.flatnonzero(~apart[owner])
    own = np.r_[0, np.cumsum(ends[chosen] - starts[chosen])[:-1]]
    train_word, train_tag = word[flat], tag[flat]
    del flat, tag
    crf = train(["clean", "toxic"], data, s[at], e[at], train_word, train_tag, own, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), epochs=3)
    del train_word, train_tag
    p = crf.marginals(crf.emissions(data, s[at], e[at]), word, starts)[:, 1]
    fits = apart if apart.any() else ~apart
    return Model(crf, logistic(evidence(p, owner, n_rows)[fits], y[fits]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, score and spans for each row's whole text.

    spans: (start, end) in code points of runs of words whose marginal reaches threshold.
    Null and empty texts have no words and the score of no evidence. Repeated rows and null
    ids stay; a doc_id may have any type; other columns are ignored.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for part in pieces(batch):
                scores, s, e, owner, p = model.tag(part.column("text"))
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p >= threshold)
                for i in np.unique(owner[hit]):
                    points = np.cumsum((np.frombuffer(part.column("text")[int(i)].as_py().encode(), np.uint8) & 0xC0) != 0x80)
                    last = -2
                    for j in hit[owner[hit] == i]:
                        a, b = int(points[s[j]]) - 1, int(points[e[j] - 1])
                        if j == last + 1:
                            found[i][-1]["end"] = b
                        else:
                            found[i].append({"start": a, "end": b})
                        last = j
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>")


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)))
    found = score(docs, model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
