"""Substring dedup by relative Lempel-Ziv parsing.

A word goes if a window of SIZE consecutive words covers it whose words also start
elsewhere, in the same document or another. Equal windows have the same least hash of K
words inside them, their anchor. One pass lists each document's anchors; those that occur
again anywhere come back to it by joins. A second cuts each document into runs, the words of
consecutive windows with one anchor, and sends the runs whose anchor occurs again to the reference
block that the anchor belongs to. There the runs are the reference: an index ranks all its places by
the words that follow, and each run is parsed greedily into the longest factors that stand elsewhere in
the reference, too, word by word and from any place on. A factor of SIZE words or more is a
duplicate span. A window may also begin inside a factor and end behind it; so where a factor
ends, the index is asked for the windows across its boundary.

An anchor that occurs more than HOT times would make its block large. Its runs are parsed
against each other where they are cut, and one of each distinct window goes on, to a smaller
block that the window's own hash names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, scratch, table
from .words import NOT_BLANK, U, grams, hashes, pieces, release, spans, text_bytes

SIZE, K = 35, 8
HOT = 20_000  #: occurrences of an anchor beyond which its windows are dealt one by one
BLOCK = 2 << 20  #: bytes of runs that one step parses, unless one anchor has more
TOP = U(2**64 - 1)


def _slide(a: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over each n consecutive values."""
    span = 1
    while span * 2 <= n:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[: len(a) - (n - span)], a[n - span :]) if n > span else a


def anchors(words: np.ndarray, owner: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the anchor of each; the anchors of all places that are one, and the places."""
    wide = size - k + 1
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.full(len(words), TOP, np.uint64)
    h, at = grams(words, owner, k)
    g[at] = np.minimum(h, TOP - U(1))
    least = _slide(g, wide, np.minimum)[: len(words) - size + 1]
    whole = owner[: len(least)] == owner[size - 1 :]
    reach = _slide(np.r_[np.zeros(wide - 1, np.uint64), np.where(whole, least, U(0)), np.zeros(wide - 1, np.uint64)], wide, np.maximum)
    places = np.flatnonzero((reach == g[: len(reach)]) & (g[: len(reach)] != TOP))
    starts = np.flatnonzero(whole)
    return starts, least[starts], g[places], places


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def list_anchors(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, text_hash, anchor, n: how often each row of docs has each of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, off = text_bytes(part.column("text"))
                s, e, owner = spans(data, off, NOT_BLANK)
                places, at = anchors(hashes(data, s, e), owner, size, k)[2:]
                order = np.lexsort((places, owner[at]))
                row, places = owner[at][order], places[order]
                first = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (row[1:] != row[:-1])]) if len(places) else np.zeros(0, np.int64)
                of = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("text_hash").take(of), _long(places[first]), pa.array(np.diff(np.r_[first, len(places)]), pa.int64())], ["doc_id", "text_hash", "anchor", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, anchor long, n long")


class Index:
    """The reference: runs of words, one after another, whose places are ranked by the words that follow.

    words: hashes; start: where each run begins, and the end. ranks[k] numbers what the 2**k
    words from each place on say, up to the run's end, so places are told apart in few steps.
    """

    def __init__(self, words: np.ndarray, start: np.ndarray, size: int) -> None:
        n = len(words)
        run = np.repeat(np.arange(len(start) - 1), np.diff(start))
        self.end = start[1:][run]
        self.left = self.end - np.arange(n)  # words from each place on
        self.most = 1  # words of a factor, at most
        rank = np.unique(words, return_inverse=True)[1]
        self.ranks = [rank]
        while self.most < size:
            k = self.most
            after = np.full(n, -1)
            inside = np.flatnonzero(self.left > k)
            after[inside] = rank[inside + k]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1]
            self.ranks.append(rank)
            self.most *= 2
        self.order = np.argsort(rank, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the places i and j have in common, up to most."""
        n = np.zeros(len(i), np.int64)
        reach = np.minimum(np.minimum(self.left[i], self.left[j]), self.most)
        for k in range(len(self.ranks) - 1, -1, -1):
            open_ = np.flatnonzero(n < reach)
            same = self.ranks[k][i[open_] + n[open_]] == self.ranks[k][j[open_] + n[open_]]
            n[open_[same]] += 1 << k
        return np.minimum(n, reach)

    def longest(self, at: np.ndarray) -> np.ndarray:
        """Words from each place on that stand elsewhere, too: what it shares with its neighbours in order."""
        found = np.zeros(len(at), np.int64)
        for step in (-1, 1):
            other = self.place[at] + step
            has = np.flatnonzero((other >= 0) & (other < len(self.order)))
            found[has] = np.maximum(found[has], self.shared(at[has], self.order[other[has]]))
        return found


def factors(words: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Duplicate spans of runs against all of them as the reference: run, first word, words.

    words: hashes, one run after another; start: where each run begins, and the end. All runs
    are parsed side by side: a round gives each its next factor, as long as the index has it.
    """
    at, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(words):
        index = Index(words, start, size)
        cursor = start[:-1][np.diff(start) > 0]
        while len(cursor):
            length = np.maximum(index.longest(cursor), 1)
            long = length >= size
            at.append(cursor[long])
            n.append(length[long])
            # Windows that begin inside the factor and end behind it.
            stop = cursor + length
            first = np.maximum(cursor + 1, stop - size + 1)
            last = np.minimum(stop - 1, index.end[cursor] - size)
            many = np.maximum(last - first + 1, 0)
            across = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            reach = index.longest(across)
            at.append(across[reach >= size])
            n.append(reach[reach >= size])
            cursor = stop[stop < index.end[cursor]]
    at, n = np.concatenate(at), np.concatenate(n)
    run = np.searchsorted(start, at, side="right") - 1
    return run, at - start[run], n


def cut_runs(part: pa.RecordBatch, wanted: np.ndarray, hot: np.ndarray, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Runs of words of windows with a wanted anchor; of hot anchors, duplicate spans and single windows.

    wanted: sorted anchors; hot: whether each is. Rows: doc_id, text_hash, key of the block,
    word where the run starts, the run; for a span that is found, no run but its end.
    """
    data, off = text_bytes(part.column("text"))
    s, e, owner = spans(data, off, NOT_BLANK)
    words = hashes(data, s, e)
    starts, anchor = anchors(words, owner, size, k)[:2]
    if not len(starts) or not len(wanted):
        return
    window = grams(words, owner, size)[0]  # of each of starts
    row = owner[starts]
    at = starts - np.searchsorted(owner, row)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(starts)])
    place = np.minimum(np.searchsorted(wanted, anchor[first]), len(wanted) - 1)
    use = wanted[place] == anchor[first]
    is_hot = hot[place] & use

    def words_of(of: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of so many windows from each on, and where they begin, with the end."""
        begin = np.r_[0, np.cumsum(length + size - 1)]
        return words[np.arange(begin[-1]) + np.repeat(starts[of] - begin[:-1], np.diff(begin))], begin

    def rows(of: np.ndarray, key: np.ndarray | None, length: np.ndarray | None, to: np.ndarray | None) -> pa.RecordBatch:
        take = pa.array(row[of])
        if length is None:
            told = [pa.nulls(len(of), pa.int64()), pa.array(at[of], pa.int32()), pa.nulls(len(of), pa.list_(pa.int64())), pa.array(to, pa.int32())]
        else:
            run, begin = words_of(of, length)
            told = [_long(key), pa.array(at[of], pa.int32()), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), _long(run)), pa.nulls(len(of), pa.int32())]
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), *told], ["doc_id", "text_hash", "key", "at", "run", "to"])

    cold = first[use & ~is_hot]
    yield rows(cold, anchor[cold], n[use & ~is_hot], None)
    if is_hot.any():
        run, i, length = factors(*words_of(first[is_hot], n[is_hot]), size)
        of = first[is_hot][run] + i
        yield rows(of, None, None, at[of] + length)
        inside = np.flatnonzero(np.repeat(is_hot, n))
        one = inside[np.unique(window[inside], return_index=True)[1]]
        yield rows(one, window[one], np.ones(len(one), np.int64), None)


def parse_blocks(runs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, lo, hi: duplicate spans in words, from runs dealt by the key of their block."""

    def made(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        lists = t.column("run").combine_chunks()
        start = lists.offsets.to_numpy().astype(np.int64)
        run, i, n = factors(lists.flatten().to_numpy().view(np.uint64), start - start[0], size)
        of = pa.array(run)
        lo = t.column("at").to_numpy()[run] + i
        take = lambda c: t.column(c).combine_chunks().take(of)
        return pa.RecordBatch.from_arrays([take("doc_id"), take("text_hash"), pa.array(lo, pa.int32()), pa.array(lo + n, pa.int32())], ["doc_id", "text_hash", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            keys = t.column("key").to_numpy()
            whole = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if whole:
                yield made(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                held_bytes = sum(b.nbytes for b in held)
        if held:
            yield made(pa.Table.from_batches(held))
        del held
        release()

    kind = runs.schema["doc_id"].dataType.simpleString()
    return runs.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"doc_id {kind}, text_hash long, lo int, hi int")


def duplicate_spans(docs: DataFrame, size: int = SIZE, k: int = K, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text_hash, text. Returns doc_id, text_hash, lo, hi of spans that repeat; spans may overlap.

    Whether an anchor occurs again comes to its documents by joins, so nothing that grows with
    the corpus passes the driver or goes to every task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = saved(list_anchors(docs, size, k), "anchors")
    repeated = listed.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    per_doc = listed.select("doc_id", "text_hash", "anchor").join(repeated, "anchor").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("anchor", "hot")).alias("own"))
    joined = docs.alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                # That an anchor repeats holds for all documents, so those of a piece are told together.
                wanted, at = np.unique(part.column("anchor").flatten().to_numpy().view(np.uint64), return_index=True)
                yield from cut_runs(part, wanted, part.column("hot").flatten().to_numpy(zero_copy_only=False)[at], size, k)

    cut = joined.select("d.doc_id", "d.text_hash", "d.text", "own.anchor", "own.hot").mapInArrow(run, f"doc_id {kind}, text_hash long, key long, at int, run array<long>, to int")
    runs = saved(cut, "runs")
    found = runs.filter("to is not null").select("doc_id", "text_hash", F.col("at").alias("lo"), F.col("to").alias("hi"))
    return parse_blocks(runs.filter("to is null").select("doc_id", "text_hash", "key", "at", "run"), size).unionByName(found)


def dedup_substrings(docs: DataFrame, size: int = SIZE, k: int = K, hot: int = HOT, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    docs: doc_id, text. Null and empty texts have no words. Rows that repeat a doc_id are
    documents of their own, so an exactly repeated row is a duplicate of the other; a null
    doc_id is an id. Texts of fewer than size words lose nothing. carry names columns of docs that come along;
    others are ignored.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", *[F.col(c).alias(f"_{c}") for c in carry])
    with scratch():
        found = duplicate_spans(keyed, size, k, hot)
        per_doc = saved(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans", keep=True)
    joined = keyed.alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                kept, n_words, n_removed = [], [], []
                texts, lo, hi = part.column("text").to_pylist(), part.column("lo").to_pylist(), part.column("hi").to_pylist()
                for text, a, b in zip(texts, lo, hi, strict=True):
                    words = _split(text)
                    n_words.append(len(words))
                    if a:
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, a, 1)
                        np.add.at(cover, b, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                    kept.append(" ".join(words))
                    n_removed.append(n_words[-1] - len(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *[part.column(f"_{c}") for c in carry]], ["doc_id", "n_words", "n_removed", "kept", *[f"_{c}" for c in carry]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    found = joined.select("d.doc_id", "d.text", "spans.lo", "spans.hi", *[F.col(f"d._{c}") for c in carry])
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string{more}").select("doc_id", "n_words", "n_removed", "kept", *[F.col(f"_{c}").alias(c) for c in carry])


def _split(text: str | None) -> list[str]:
    """[^\\x20\\x09-\\x0D]+: bytes.split() parts at just these six; str.split() at more."""
    return [w.decode() for w in (text or "").encode().split()]


def op3_substring_dedup(spark, sf_dir):
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 34)) AS i, w FROM d WHERE len(w) >= 35
), win AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS h FROM pos
), dup AS (
  SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING COUNT(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM dup
), said AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), kept AS (
  SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.j) AS text, COUNT(*) AS n FROM said s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.j = g.j GROUP BY s.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - COALESCE(k.n, 0))::BIGINT AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
