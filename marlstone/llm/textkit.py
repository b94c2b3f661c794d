"""Small numpy helpers over whole batches of texts, for the operators that run in Python tasks.

Texts stay UTF-8 bytes in one buffer; words, hashes and windows are arrays over it, so nothing is done per word
in Python. Batches are cut by bytes, not rows, so memory is bounded by one batch or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2_000_000

_U = np.uint64
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOW = np.arange(256)
_LOW[65:91] += 32
_LOWERED = _BYTE[_LOW]
_SPACE = np.ones(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes at most, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and its n + 1 offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]] if len(o) else b, o - o[0]


def words(b: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of every word, and the n + 1 word offsets of the texts. Words never cross texts."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = in_word[b]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each piece b[start:end]; A-Z counts as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, _U)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    at = np.repeat(starts, sizes) + place
    weight = mix(np.arange(int(sizes.max()), dtype=_U)) | _U(1)
    with np.errstate(over="ignore"):
        h = np.add.reduceat((_LOWERED if lower else _BYTE)[b[at]] * weight[place], first)
    return mix(h ^ sizes.astype(_U))


_ROLES = mix(np.arange(1, 65, dtype=_U) * _U(1_000_003)) | _U(1)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` word hashes; all of them as one window if there are fewer, but some."""
    n = len(h)
    if not n:
        return h
    width = min(width, n)
    s = np.zeros(n - width + 1, _U)
    with np.errstate(over="ignore"):
        for j in range(width):
            s += h[j : j + n - width + 1] * _ROLES[j]
    return mix(s ^ _U(width))
