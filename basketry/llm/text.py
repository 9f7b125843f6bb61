"""Vectorised text helpers shared by the operators: Arrow string batches as byte arrays.

A batch is cut into slices of a few MB, so a task holds a bounded number of
bytes at a time however many rows a batch has (one longer text is one slice).
All functions work on UTF-8 bytes; a byte >= 0x80 always belongs to a code
point >= U+0080, so the byte classes below are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_M64 = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
LOWER_TABLE = _LOWER.tobytes()
#: Word bytes of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[ord("0"):ord("9") + 1] = True
ALNUM[ord("a"):ord("z") + 1] = True
ALNUM[0x80:] = True


def splitmix(x: int) -> int:
    """One fixed, well-mixed 64-bit value for each small integer."""
    z = (x * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _M64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return z ^ (z >> 31)


_BYTE_VALUE = np.array([splitmix(i) for i in range(256)], np.uint64)
_BASE = splitmix(1001) | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the usual slice size only."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.empty(max(n, 1 << 16), np.uint64)
        got[0] = 1
        got[1:] = base
        np.multiply.accumulate(got, out=got)
        if len(got) <= 2 * SLICE_BYTES:
            _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the low bits of a product over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty."""
    texts = batch.column(column)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, width)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Words of more bytes are hashed by a digest: modulo 2 ** 64 any two Thue-Morse words of 1,024 letters and more are equal.
POLYNOMIAL_BYTES = 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, polynomial: int = POLYNOMIAL_BYTES) -> np.ndarray:
    """64-bit hash of every word: a polynomial over fixed byte values, from prefix sums; of words over ``polynomial`` bytes a digest."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * _powers(_BASE, len(data)), out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * _powers(_UNBASE, len(data) + 1)[starts])
    for k in np.flatnonzero(ends - starts > polynomial).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]], digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes (also across rows; the caller masks those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, splitmix(5000 + n), np.uint64)
    for k in range(n):
        h += words[k:k + m] * np.uint64(splitmix(2000 + k) | 1)
    return mix(h)


def inside_rows(firsts: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each window start: whether the ``n`` words lie in one row."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    for k in range(1, n):
        at = firsts[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok
