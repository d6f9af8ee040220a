"""Cross-tokenizer alignment.

Two tokenizers cut the same bytes. The texts of an Arrow batch are one run of bytes with the
documents' offsets; the ends of all tokens of either side are counted by byte once, and
where both sides end is a cut. Running sums of the cuts number the groups between them, and
differences of running sums at the documents' offsets are their results.

Ids that share a group are linked. How many documents hold a linked pair is counted over
the corpus: a batch's documents keep their distinct pairs, of which a batch has far fewer than
its documents together, so pairs are counted and told batch by batch.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, scratch, table
from .words import pieces, text_bytes

SPACE = "▁"
STEP = 1 << 20  #: bytes of text that are aligned at once, unless one text is longer
MADE = 1 << 20  #: pairs that are made before they are reduced to distinct ones
FEW = 16  #: links of a group beyond which its distinct ids are paired instead of their places


class Side:
    """A vocabulary's bytes: of id i, data[off[i]:off[i + 1]]."""

    def __init__(self, entries: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.off = np.r_[0, np.cumsum([len(e) for e in entries])].astype(np.int64)
        self.size = np.diff(self.off)


def gathered(data: np.ndarray, off: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of the entries ids, one after another."""
    n = size[ids]
    begin = np.cumsum(n) - n
    return data[np.arange(n.sum()) + np.repeat(off[ids] - begin, n)]


def byte_level(entry: str) -> bytes:
    """What a byte-level entry stands for: printable Latin-1 is itself, other bytes are shifted beyond it."""
    return b"".join(_BYTE[c] for c in entry)


_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {chr(b): bytes([b]) for b in _PRINTED} | {chr(256 + i): bytes([b]) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Tokenizers:
    """A: a byte-level BPE of the tokenizers library, given a space and the text; B: a sentencepiece model that adds the space."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        number = {byte_level(e): i for e, i in told["model"]["vocab"].items() if e not in special}
        entries = [b""] * (max([*number.values(), *special.values()]) + 1)
        for entry, i in [*number.items(), *((e.encode(), i) for e, i in special.items())]:
            entries[i] = entry
        self.side_a = Side(entries)
        self.ranked = ranked(told, number)
        del told, number
        if not self.ranked:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            import tokenizers

            self.a = tokenizers.Tokenizer.from_file(path_a)
            self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.side_b = Side([piece(i) for i in range(self.b.get_piece_size())])
        self.n_a, self.n_b = len(self.side_a.size), len(self.side_b.size)
        number = [str(i).encode() for i in range(max(self.n_a, self.n_b))]
        self.number = Side(number)

    def encode_a(self, text: str) -> np.ndarray:
        if self.ranked:
            return self.ranked.encode_to_numpy(" " + text).astype(np.int32)
        return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of either side the ids of all texts, and how many each text has."""
        said = [self.encode_a(t) for t in texts], [np.array(self.b.encode(t), np.int32) for t in texts]
        none = np.zeros(0, np.int32)
        return tuple((np.concatenate([none, *lists]), np.array([len(x) for x in lists], np.int64)) for lists in said)


def ranked(told: dict, number: dict[bytes, int]):
    """The vocabulary of a tokenizers file as ranks, which tiktoken reads several times as fast, or None.

    Merging by ids is merging by the list of merges if each merge makes a higher id than the one
    before, and both libraries part texts alike if the file asks for just the byte-level pattern.
    """
    import tiktoken

    model, split = told["model"], told["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or told["normalizer"]:
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    made = [number.get(byte_level("".join(m.split(" ") if isinstance(m, str) else m)), -1) for m in model["merges"]]
    if -1 in made or any(x >= y for x, y in zip(made, made[1:], strict=False)) or {i for e, i in number.items() if len(e) > 1} != set(made):
        return None
    return tiktoken.Encoding("entries", pat_str=PATTERN, mergeable_ranks=number, special_tokens={})


#: How byte-level vocabularies part texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Aligned:
    """The alignment of a batch's texts; those that a side doesn't spell out have no tokens."""

    def __init__(self, with_: Tokenizers, texts: pa.Array) -> None:
        self.by, self.n = with_, len(texts)
        data, off = text_bytes(texts)
        rows = np.flatnonzero(np.diff(off) > 0)
        shown = texts.take(pa.array(rows)).to_pylist()
        data, off = np.insert(data, off[rows], 32), np.r_[off[rows] + np.arange(len(rows)), len(data) + len(rows)]
        sides = []
        good = np.ones(len(rows), bool)
        for side, (ids, n) in zip((with_.side_a, with_.side_b), with_.encode(shown), strict=True):
            of = np.repeat(np.arange(len(rows)), n)
            good &= np.bincount(of, side.size[ids], len(rows)) == np.diff(off)
            sides.append((side, ids, of))
        # Those of the right length lie byte by byte beside their texts.
        while True:
            inside = np.repeat(good, np.diff(off))
            here, begin = data[inside], np.r_[0, np.cumsum(np.diff(off)[good])]
            kept = [(side, ids[good[of]], of[good[of]]) for side, ids, of in sides]
            differs = np.zeros(len(here), bool)
            for side, ids, _ in kept:
                differs |= gathered(side.data, side.off, side.size, ids) != here
            if not differs.any():
                break
            good[np.flatnonzero(good)[np.searchsorted(begin, np.flatnonzero(differs), side="right") - 1]] = False
        number = np.cumsum(good) - 1
        self.rows = rows[good]  # of the batch; texts are numbered by their place among these
        self.docs = len(self.rows)
        (_, self.a, of_a), (_, self.b, of_b) = kept
        self.doc_a, self.doc_b = number[of_a], number[of_b]
        end_a, end_b = np.cumsum(with_.side_a.size[self.a]), np.cumsum(with_.side_b.size[self.b])
        cut = (np.bincount(end_a, minlength=len(here) + 1) > 0) & (np.bincount(end_b, minlength=len(here) + 1) > 0)
        upto = np.cumsum(cut)
        self.group_a, self.group_b = upto[end_a] - cut[end_a], upto[end_b] - cut[end_b]
        self.groups = int(upto[-1])
        self.has_a, self.has_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        self.first_group = upto[begin]  # of each text, and the end

    def sums(self) -> dict[str, np.ndarray]:
        """n_a, n_b, n_groups, n_links of each row of the batch."""
        links = np.r_[0, np.cumsum(self.has_a * self.has_b)][self.first_group]
        found = {"n_a": np.bincount(self.doc_a, minlength=self.docs), "n_b": np.bincount(self.doc_b, minlength=self.docs), "n_groups": np.diff(self.first_group), "n_links": np.diff(links)}
        whole = {c: np.zeros(self.n, np.int64) for c in found}
        for c, x in found.items():
            whole[c][self.rows] = x
        return whole

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1;a3|b2,b3 of all texts as bytes, and where each begins, with the end."""
        before_a, before_b = np.cumsum(self.has_a) - self.has_a, np.cumsum(self.has_b)
        n = len(self.a) + len(self.b)
        at_a = np.arange(len(self.a)) + (before_b - self.has_b)[self.group_a]
        at_b = np.arange(len(self.b)) + (before_a + self.has_a)[self.group_b]
        ids, mark = np.zeros(n, np.int32), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        last_a, last_b = before_a + self.has_a - 1, before_b - 1
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        digits = self.by.number
        width = digits.size[ids] + 1
        out = np.zeros(width.sum(), np.uint8)
        ends = np.cumsum(width)
        is_mark = np.zeros(len(out), bool)
        is_mark[ends - 1] = True
        out[~is_mark] = gathered(digits.data, digits.off, digits.size, ids)
        out[ends - 1] = mark
        # A text's last group ends without its mark; the mark is skipped by whoever cuts.
        return out, np.r_[0, ends[at_b[last_b[self.first_group[1:] - 1]]]] if self.docs else np.zeros(1, np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its distinct linked pairs, a * n_b + b, ascending, and how often: offsets, pairs, times."""
        wide = self.by.n_a * self.by.n_b

        def entries(group: np.ndarray, ids: np.ndarray, many: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
            in_many = many[group]
            if not in_many.any():
                return group, ids.astype(np.int64), np.ones(len(ids), np.int64)
            key, n = np.unique(group[in_many] * size + ids[in_many], return_counts=True)
            g, i, n = np.r_[group[~in_many], key // size], np.r_[ids[~in_many], key % size], np.r_[np.ones((~in_many).sum(), np.int64), n]
            order = np.argsort(g, kind="stable")
            return g[order], i[order], n[order]

        many = self.has_a * self.has_b > FEW
        g_a, a, n_a = entries(self.group_a, self.a, many, self.by.n_a)
        g_b, b, n_b = entries(self.group_b, self.b, many, self.by.n_b)
        width = np.bincount(g_b, minlength=self.groups)
        start = np.cumsum(width) - width
        doc_of = np.repeat(np.arange(self.docs), np.diff(self.first_group))
        made = np.r_[0, np.cumsum(width[g_a])]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(made, made[i] + MADE, side="right")) - 1)
            n = width[g_a[i:j]]
            left = np.repeat(np.arange(i, j), n)
            right = np.arange(len(left)) + np.repeat(start[g_a[i:j]] - (np.cumsum(n) - n), n)
            key = doc_of[g_a[left]] * wide + a[left] * self.by.n_b + b[right]
            held.append(_summed(key, n_a[left] * n_b[right]))
            if len(held) > 1 and sum(len(k) for k, _ in held[1:]) > MADE:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            i = j
        if not held:
            return np.zeros(self.docs + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, times = held[0] if len(held) == 1 else _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return np.searchsorted(key, np.arange(self.docs + 1) * wide), key % wide, times


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (n == 1).all():
        return np.unique(key, return_counts=True)
    found, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, n)
    return found, total


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    key = (path_a, path_b)
    return _LOADED.get(key) or _LOADED.setdefault(key, Tokenizers(*key))


def align(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """One row for each row of docs: unit, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    docs: doc_id, text. groups spells the ids of both sides group by group, a1,a2|b1;a3|b2,b3, or
    is the SHA-256 of that with digests ('' either way for a text without tokens); pairs are
    the distinct linked ids, a * (size of B's vocabulary) + b, ascending, and times how often
    each is linked. unit numbers the batch that a row was in, which changes from run to run.
    Null and empty texts, and those that a side doesn't spell out, have no tokens. Repeated
    rows are documents of their own, a null doc_id stays, other columns are ignored. A text is
    held by one task. Both paths must name the files on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _tokenizers(path_a, path_b)
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, most=STEP):
                found = Aligned(by, part.column("text"))
                data, at = found.spelled()
                shown = [""] * part.num_rows
                for row, lo, hi in zip(found.rows, at[:-1], at[1:], strict=True):
                    shown[row] = hashlib.sha256(data[lo : hi - 1]).hexdigest() if digests else data[lo : hi - 1].tobytes().decode()
                off, pair, times = found.pairs()
                size = np.zeros(part.num_rows, np.int64)
                size[found.rows] = np.diff(off)
                ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                sums = found.sums()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, unit)), part.column("doc_id"), *[pa.array(sums[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(shown, pa.string())]
                    + [pa.ListArray.from_arrays(ends, pa.array(pair)), pa.ListArray.from_arrays(ends, pa.array(times))],
                    ["unit", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )
                unit += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"unit long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def linked_in(held: DataFrame, n_b: int) -> DataFrame:
    """held: unit, pair, n (documents of the unit that hold it). Adds count, over all units, and best.

    best: no pair of the same A id has a higher count. The highest counts are a row for each A
    id, so no more than A's vocabulary, and go to every task.
    """
    counted = saved(held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.floor(F.col("pair") / n_b)), "counts")
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    return held.join(counted.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair")


def aligned_links(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """What align gives of each row of docs, and n_best and count_sum instead of unit and pairs.

    A link's count is the number of documents (rows of docs) that hold its pair of ids
    linked; count_sum sums it over a document's links, and n_best counts the links whose count is
    the highest of their A id, ties included. Without rows nothing is returned.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    with scratch():
        each = saved(align(docs, path_a, path_b, digests), "aligned")
        held = saved(each.select("unit", F.explode("pairs").alias("pair")).groupBy("unit", "pair").agg(F.count(F.lit(1)).alias("n")), "held")
        told = linked_in(held, n_b).select("unit", "pair", "count", "best")

        def score(rows: pa.Table, known: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            lists, times = rows.column("pairs").combine_chunks(), rows.column("times").combine_chunks()
            off = lists.offsets.to_numpy().astype(np.int64)
            pair, n = lists.flatten().to_numpy(), times.flatten().to_numpy()
            known = known.sort_by("pair")
            at = np.searchsorted(known.column("pair").to_numpy(), pair)
            upto = lambda x: np.r_[0, np.cumsum(x)]
            counts = upto(known.column("count").to_numpy()[at] * n)
            best = upto(known.column("best").to_numpy()[at] * n)
            off = off - off[0]
            total = [pa.array(x[off[1:]] - x[off[:-1]], pa.int64()) for x in (best, counts)]
            return pa.Table.from_arrays([rows.column(c) for c in columns] + total, [*columns, "n_best", "count_sum"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        found = each.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(score, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
        return saved(found, "links", keep=True)


def op11_alignment(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = aligned_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
