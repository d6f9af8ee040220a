"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label; forward-backward marginals over affix, n-gram and
lexicon features are summed over a text's words. Training chains splice stretches of texts
in different languages together, so transitions learn that code-switched text stays in a
language for some words and then may leave it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crf import CHAIN, CRF, chain_starts, train
from .shared import small_batches, table
from .words import LOWER, byte_set, hashes, pieces, spans, text_bytes

SAMPLE_BYTES = 48 << 20  #: of text in a labelled sample, at most
LABELS = 128  #: of a model, at most
SENT = 100_000  #: up to so many ids are sent to every task; more are joined by a shuffle
#: letters of ASCII, and every byte of longer characters
LETTERS = byte_set(range(65, 91), range(97, 123), range(128, 256))


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters in UTF-8."""
    out = LOWER[data]
    after = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[after] += 0x20
    return out


def within_bytes(chosen: DataFrame, label: str, most: int, most_bytes: int) -> list:
    """(doc_id, label, text) of rows of chosen, sorted: at most `most` rows and most_bytes of text.

    chosen: doc_id, text and the label, already few rows. Those whose ids hash lowest come
    first; a row that would exceed the bytes is left out, and smaller ones after it may fit.
    Sizes reach the driver before any text does.
    """
    sized = chosen.select(F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.xxhash64("doc_id").alias("h"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    left, few = most_bytes, []
    for key, rows in groupby(sized.orderBy("h", "t").limit(most).collect(), key=lambda r: (r["h"], r["t"])):  # repeated rows together
        size = sum(r["bytes"] for r in rows)
        if size <= left:
            left -= size
            few.append(key)
    told = chosen.sparkSession.createDataFrame(few, "h long, t long")
    texts = chosen.withColumns({"h": F.xxhash64("doc_id"), "t": F.xxhash64(F.coalesce("text", F.lit("")))}).join(F.broadcast(told), ["h", "t"])  # at most `most` rows
    return sorted(((r["doc_id"], r[label], r["text"] or "") for r in texts.limit(most).toLocalIterator()), key=lambda r: (r[0], str(r[1]), r[2]))


def sample_texts(labelled: DataFrame, per_label: int, most_bytes: int = SAMPLE_BYTES) -> list:
    """At most per_label texts of each label, those whose ids hash lowest, and most_bytes in all.

    labelled: doc_id, text, label. This bounds what the driver holds; ranks are cut before
    the shuffle, so a frequent label doesn't reach one task whole.
    """
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("doc_id", "label").dropna().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_label).select("doc_id", "label")
    few = ids.count()
    ids = F.broadcast(ids) if few <= SENT else ids  # few labels: the texts stay where they are
    chosen = labelled.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "label")
    return within_bytes(chosen, "label", max(1, few), most_bytes)


def fit(labelled: DataFrame, per_label: int = 250, lexicon_size: int = 300, seed: int = 11, most_bytes: int = SAMPLE_BYTES) -> CRF:
    """Learn from labelled: doc_id, text, label, of which a bounded sample is taken.

    The sample has at most per_label texts of each label and most_bytes of text; all words of
    its texts train. Rows without id or label take no part; null texts have no words; repeated
    rows count again; ties in hash go by id. Nothing labelled: no labels. The model has a
    megabyte for each label and goes to every task, so more than LABELS labels are an error.
    """
    rows = sample_texts(labelled, per_label, most_bytes)
    labels = sorted({r[1] for r in rows})
    if len(labels) > LABELS:
        raise ValueError(f"a model of more than {LABELS} labels is too large to send to every task")
    rng = np.random.default_rng(seed)
    if not labels:
        return CRF([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
    raw, off = text_bytes(pa.array([r[2] for r in rows], pa.large_string()))
    data = _fold(raw)
    s, e, owner = spans(data, off, LETTERS)
    h = hashes(data, s, e)
    label = np.array([labels.index(r[1]) for r in rows])[owner] if len(owner) else np.zeros(0, np.int64)
    distinct, at, word = np.unique(h, return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(word[label == j], minlength=len(distinct)) for j in range(len(labels))])
    listed = [np.zeros((0, 2), np.int64)]
    for j, c in enumerate(counts):
        top = np.argsort(-c, kind="stable")[:lexicon_size]
        top = top[c[top] > 1]
        listed.append(np.stack([top, np.full(len(top), j)], 1))
    lists = np.concatenate(listed)
    lists = lists[np.lexsort((lists[:, 1], lists[:, 0]))]
    keep, lists[:, 0] = np.unique(lists[:, 0], return_inverse=True)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    stretches = []
    for i, j in zip(first, np.r_[first[1:], len(owner)], strict=True):
        at_, end = int(i), int(j)
        while at_ < end:
            n = int(rng.integers(6, 48))
            stretches.append(np.arange(at_, min(end, at_ + n)))
            at_ += n
    # Shuffled stretches follow one another within a chain, so it changes language at their ends.
    tokens, starts, used = [], [], CHAIN
    for i in rng.permutation(len(stretches)):
        if used + len(stretches[i]) > CHAIN or rng.random() < 0.3:
            starts.append(starts[-1] + used if starts else 0)
            used = 0
        tokens.append(stretches[i])
        used += len(stretches[i])
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    if not len(flat):
        return CRF(labels, np.zeros((1 << 18, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(len(labels)), distinct[keep], lists)
    return train(labels, data, s[at], e[at], word[flat], label[flat], np.array(starts), distinct[keep], lists, epochs=3)


def text_scores(model: CRF, texts: pa.Array) -> np.ndarray:
    """Of each text, the share of each label in its words."""
    raw, off = text_bytes(texts)
    data = _fold(raw)
    s, e, owner = spans(data, off, LETTERS)
    out = np.zeros((len(texts), len(model.labels)))
    if len(s) and model.labels:
        _, at, back = np.unique(hashes(data, s, e), return_index=True, return_inverse=True)
        m = model.marginals(model.emissions(data, s[at], e[at]), back, chain_starts(owner))
        for j in range(len(model.labels)):
            out[:, j] = np.bincount(owner, m[:, j], len(texts))
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def identify(docs: DataFrame, model: CRF, carry: Sequence[str] = ()) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, lang_pred, score for each row's whole text.

    lang_pred is a learned label; 'und' with score 0 if the text is null, empty or has no
    letter, or if nothing was learned. score is the share of the label in the text's words.
    Ties go to the first label in order. Repeated rows and null ids stay. carry names columns
    of docs that come along; others are ignored.
    """
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte for each of at most LABELS labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for part in pieces(batch):
                shares = text_scores(model, part.column("text"))
                best = shares.argmax(axis=1) if model.labels else np.zeros(part.num_rows, np.int64)
                found = shares.max(axis=1) if model.labels else np.zeros(part.num_rows)
                names = [model.labels[b] if f > 0 else "und" for b, f in zip(best, found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.minimum(found, 1.0), pa.float64()), part.column("letter"), *[part.column(f"_{c}") for c in carry]], ["doc_id", "lang_pred", "score", "letter", *[f"_{c}" for c in carry]])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    more = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    found = docs.select("doc_id", "text", letter, *[F.col(c).alias(f"_{c}") for c in carry]).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, letter boolean{more}")
    return found.select("doc_id", F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"), *[F.col(f"_{c}").alias(c) for c in carry])


def held_out(modulus: int, left: int):
    """Whether crc32 of doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == left, F.lit(False))


def fit_documents(docs: DataFrame) -> CRF:
    return fit(docs.filter(~held_out(5, 0)).select("doc_id", "text", F.col("lang").alias("label")))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
