"""Token counts by rank-synchronous array merging.

Counts the tokens of a BPE model in sentencepiece's format exactly as that library does,
without calling it on texts. A text is cut into pre-tokens at places that no merge can
cross. The distinct pre-tokens of a batch are held as one ragged array of symbols. Each
round finds every sequence's lowest-rank pair and merges it in all sequences at once;
sequences without a pair leave. What survives is counted: a symbol outside the vocabulary
counts its UTF-8 bytes.

Pre-tokens of more than LONG symbols merge in many places at once: no symbol outgrows the
longest piece, so a pair that has the lowest rank as far around as that reaches merges as it
would in its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .words import U, hashes, pieces, text_bytes

NONE = np.int32(2**31 - 1)
LONG = 200  #: symbols beyond which a pre-token merges in many places at once
SPACE = "▁"


class Merges:
    """The model's tables: symbols of code points, and the rank and result of pairs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        alphabet = sorted({c for p in vocabulary for c in p})
        symbols = list(dict.fromkeys([*alphabet, *vocabulary]))
        number = {p: i for i, p in enumerate(symbols)}
        unknown = np.array([len(p.encode()) if p not in vocabulary else 1 for p in symbols], np.int64)
        self.n = len(symbols)
        # Unknown code points are the symbols n + 1 ... n + 4, by their number of UTF-8 bytes.
        self.size = np.concatenate([unknown, [0, 1, 2, 3, 4]])
        cp = np.arange(0x110000)
        self.symbol = (self.n + 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int32)
        for c in alphabet:
            self.symbol[ord(c)] = number[c]
        scores = sorted({s for s in vocabulary.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        keys, values = [], []
        for p, s in vocabulary.items():
            for i in range(1, len(p)):
                if p[:i] in number and p[i:] in number:
                    keys.append(number[p[:i]] * (self.n + 5) + number[p[i:]])
                    values.append((rank[s], number[p]))
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        for k, (r, m) in zip(keys, values, strict=True):
            at = int(self._slot(np.array([k]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.made[at] = k, r, m
        #: ASCII bytes that occur in no piece of several characters stand alone; so they part pre-tokens.
        inner = {c for p in vocabulary if len(p) > 1 for c in p}
        self.alone = np.array([b < 128 and b != 32 and chr(b) not in inner for b in range(256)])
        self.longest = max((len(p) for p in vocabulary), default=1)
        own = [i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i)]
        for text in ("\ufb01 \uff21  x", "x", " x", "<s>", "</s>", "<unk>", *(model.id_to_piece(i) for i in own)):
            if model.decode(model.encode(text)) != text or any(i in own and not model.is_unknown(i) for i in model.encode(text)):
                raise ValueError("the model normalizes texts or takes special strings in them as pieces; this counter doesn't")
        if any(SPACE in p.lstrip(SPACE) for p in vocabulary):
            raise ValueError("a piece holds a space after other characters; pre-tokens can't be cut at spaces")

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and result of the pairs a, b."""
        k = a.astype(np.int64) * (self.n + 5) + b
        at = self._slot(k)
        open_ = np.flatnonzero((self.keys[at] != k) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            now = self.keys[at[open_]]
            open_ = open_[(now != k[open_]) & (now != -1)]
        return self.ranks[at], self.made[at]

    def counts(self, sym: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Surviving tokens of each sequence sym[start[i]:start[i + 1]]; none is empty."""
        out = np.zeros(len(start), np.int64)
        seq = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(sym)]))
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self.find(sym[same], sym[same + 1])[0]
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            done = least == NONE
            if done.any():
                gone = np.repeat(done, length)
                out += np.bincount(seq[gone], self.size[sym[gone]], len(out)).astype(np.int64)
                sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
                if not len(sym):
                    break
                least, length = least[~done], length[~done]
            at = np.flatnonzero(rank == np.repeat(least, length))
            made = self.find(sym[at], sym[at + 1])[1]
            # The leftmost pair of a sequence merges. Others of the same rank merge in the same
            # round if they stand apart and if no merge makes a pair of as low a rank, which
            # would have come first had they been taken one by one.
            lead = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            ok = lead | np.r_[True, np.diff(at) >= 3]
            left = np.maximum(at - 1, 0)
            right = np.minimum(at + 2, len(sym) - 1)
            left_rank = np.where((at > 0) & (seq[left] == seq[at]), self.find(sym[left], made)[0], NONE)
            right_rank = np.where((at + 2 < len(sym)) & (seq[right] == seq[at]), self.find(made, sym[right])[0], NONE)
            early = np.minimum(left_rank, right_rank) <= rank[at]
            if early.any() or not ok.all():
                group = np.cumsum(lead) - 1
                unsafe = np.zeros(group[-1] + 1, bool)
                unsafe[group[early]] = True
                unsafe[group[~ok]] = True
                take = lead | ~unsafe[group]
                at, made, left, left_rank, right_rank = at[take], made[take], left[take], left_rank[take], right_rank[take]
            has_left = (at > 0) & (seq[left] == seq[at])
            sym[at] = made
            rank[at] = right_rank
            rank[left[has_left]] = left_rank[has_left]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
        return out

    def long_counts(self, sym: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What counts() gives, for long sequences.

        A merge before a pair's turn makes a symbol that holds a pair of lower rank, and no
        symbol is longer than the longest piece. So a pair is not touched before its turn if
        none within `wide` symbols has a lower rank. Of equal ranks the leftmost comes first:
        those that stand as near as that merge in one round up to the first that makes a pair
        of as low a rank.
        """
        wide = self.longest
        last = np.zeros(len(sym), bool)
        last[np.r_[start[1:], len(sym)] - 1] = True
        seq = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(sym)]))
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.find(sym[inner], sym[inner + 1])[0]
        while True:
            low = (rank < NONE) & (rank == least_around(rank, wide, wide))
            at = np.flatnonzero(low)
            if not len(at):
                return np.bincount(seq, self.size[sym], len(start)).astype(np.int64)
            # An equal rank on the left that has to wait itself holds this one up, too.
            waits = least_around(np.where(low, NONE, rank), wide, 0)[at] == rank[at]
            head = np.r_[True, np.diff(at) > 1]
            every_other = (np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 0
            at, waits = at[every_other], waits[every_other]
            made = self.find(sym[at], sym[at + 1])[1]
            left = np.maximum(at - 1, 0)
            before = np.where(np.r_[False, np.diff(at) == 2], np.r_[made[:1], made[:-1]], sym[left])
            left_rank = np.where((at > 0) & ~last[left], self.find(before, made)[0], NONE)
            right_rank = np.where(last[at + 1], NONE, self.find(made, sym[np.minimum(at + 2, len(sym) - 1)])[0])
            early = np.minimum(left_rank, right_rank) <= rank[at]
            stop = waits | np.r_[False, early[:-1]]  # from here on in its group
            group = np.cumsum(np.r_[True, np.diff(at) > wide]) - 1
            first = np.flatnonzero(np.r_[True, np.diff(group) > 0])
            stop[first] = waits[first]
            stops = np.cumsum(stop)
            take = stops - np.r_[0, stops][first][group] == 0
            at, made = at[take], made[take]
            sym[at] = made
            last[at] = last[at + 1]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, seq, rank, last = sym[stay], seq[stay], rank[stay], last[stay]
            at -= np.arange(len(at))
            for pair in (at, at[at > 0] - 1):
                inner = ~last[pair]
                rank[pair] = NONE
                rank[pair[inner]] = self.find(sym[pair[inner]], sym[pair[inner] + 1])[0]

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")  # the model takes either for a space
        data, off = text_bytes(texts)
        full = np.flatnonzero(np.diff(off) > 0)
        total = np.zeros(len(texts), np.int64)
        if not len(full):
            return total
        data = np.insert(data, off[full], 32)  # the model puts a space before each text
        off = np.r_[off[full] + np.arange(len(full)), len(data)]
        blank, alone = data == 32, self.alone[data]
        cut = alone.copy()
        cut[1:] |= alone[:-1] | (blank[1:] & ~blank[:-1])
        cut[off[:-1]] = True
        s = np.flatnonzero(cut)
        e = np.r_[s[1:], len(data)]
        owner = full[np.searchsorted(off, s, side="right") - 1]
        single = alone[s]
        np.add.at(total, owner[single], 1)
        s, e, owner = s[~single], e[~single], owner[~single]
        if len(s):
            _, at, back = np.unique(hashes(data, s, e), return_index=True, return_inverse=True)
            total += np.bincount(owner, self._distinct(data, s[at], e[at])[back], len(texts)).astype(np.int64)
        return total

    def _distinct(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        n = e - s
        start = np.r_[0, np.cumsum(n)]
        flat = data[np.arange(start[-1]) - np.repeat(start[:-1] - s, n)]
        heads = (flat & 0xC0) != 0x80
        heads[start[:-1]] = True
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = np.cumsum(heads)[start[:-1]] - 1
        sym = self.symbol[np.where(points == 32, ord(SPACE), points)]
        size = np.diff(np.r_[first, len(sym)])
        long = size > LONG
        if not long.any():
            return self.counts(sym, first)
        found = np.zeros(len(first), np.int64)
        of = np.repeat(long, size)
        found[long] = self.long_counts(sym[of], np.r_[0, np.cumsum(size[long])[:-1]])
        if not long.all():
            found[~long] = self.counts(sym[~of], np.r_[0, np.cumsum(size[~long])[:-1]])
        return found


def least_around(a: np.ndarray, before: int, after: int) -> np.ndarray:
    """The least of each value, as many before it and as many after it."""
    n, span = before + after + 1, 1
    a = np.concatenate([np.full(before, NONE, a.dtype), a, np.full(after, NONE, a.dtype)])
    while span * 2 <= n:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (n - span)], a[n - span :]) if n > span else a


_LOADED: dict[str, Merges] = {}


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes and n_tokens of each row's whole text.

    Null and empty texts have no bytes and no tokens; repeated rows stay; a null doc_id stays;
    other columns are ignored. model_path must name the file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _LOADED.get(model_path) or _LOADED.setdefault(model_path, Merges(model_path))
        for batch in batches:
            for part in pieces(batch):
                n_bytes = np.diff(text_bytes(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(merges.of_texts(part.column("text")), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
