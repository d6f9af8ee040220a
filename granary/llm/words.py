"""Words and their hashes over Arrow string arrays, without a Python loop over words.

A word's hash is a sum of byte codes times powers of an odd base, modulo 2**64. Running
sums over the bytes give every word's sum at once; the inverse power of the base shifts it
to the word's own start. A final mix spreads the bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = 1 << 16  #: bytes that are summed at once, about; they stay in a core's cache
_SUB = 1 << 20  #: bytes of text that a step of work holds, unless one text is longer


def byte_set(*codes: int | range) -> np.ndarray:
    found = np.zeros(256, bool)
    for c in codes:
        found[list(c) if isinstance(c, range) else c] = True
    return found


#: [^\x20\x09-\x0D]+
NOT_BLANK = ~byte_set(0x20, range(0x09, 0x0E))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        a = np.full(max(n, _STEP + 4096), base, np.uint64)
        a[0] = 1
        _POWERS[base] = np.cumprod(a)
    return _POWERS[base][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes that are inside."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    w = inside.take(data, mode="clip")
    first = w.copy()
    first[1:] &= ~w[:-1]
    at = off[:-1][off[:-1] < len(data)]
    first[at] = w[at]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = off[1:][off[1:] > 0] - 1
    last[at] = w[at]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(s, off)))


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each data[s:e]; s and e ascend."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(s, s[i] + _STEP)))
        lo, hi = int(s[i]), int(e[j - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_CODE.take(data[lo:hi], mode="clip") * powers(_BASE, hi - lo), out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (total[b] - total[a]) * powers(_UNBASE, hi - lo + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each n consecutive words of one text, and where it starts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * U(0xD6E8FEB86659FD93) + words[i : m + i]
    return mixed(h[at]), at


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that isn't in use back to the system: a worker lives on when its task has ended, and keeps what it doesn't."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = _SUB) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text, or of one row; memory is released after the last."""
    _, off = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()


def by_pieces(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives work slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return run
