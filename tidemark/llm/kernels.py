"""Vectorised text kernels that run on Arrow string columns inside tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z, so
the kernels work on UTF-8 bytes and never decode. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at a time; bounds the working arrays, not the texts.
CHUNK = 1 << 20
#: Longest span in bytes that is hashed by sums of powers; longer ones are digested.
LINEAR = 64

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, CHUNK), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them): runs of rows of about ``size``
    bytes, one row at least. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more at the
    end). ``gap`` tells of each byte whether it stands between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~gap[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for the bytes of each span, wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(_BASE, len(data)), out=total[1:])
    out = mix((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    # sums of powers can be made to collide in long strings
    for i in np.flatnonzero(ends - starts > LINEAR):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, across row borders too."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _STEP[j]
    return mix(out)


def shingles(column: pa.Array, k: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its k-word shingles in order). With fewer than k words the whole
    sequence is one shingle; without words there is none."""
    for first, last, data, offsets in text_chunks(column):
        data = LOWER[data] if lower else data
        starts, ends, head = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        runs = run_hashes(words, k)
        for row in range(first, last):
            a, b = head[row - first], head[row - first + 1]
            if b - a >= k:
                yield row, runs[a : b - k + 1]
            elif b > a:
                short = words[a:b] * _STEP[: b - a]
                yield row, mix(short.sum(keepdims=True) + U64(int(b - a)))
            else:
                yield row, words[:0]


def tidy(f: Callable) -> Callable:
    """``f`` for mapInArrow; at its end the worker, which lives on for later tasks, gives freed
    memory back to the system."""

    def run(batches):
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not the GNU library
            pass

    return run
