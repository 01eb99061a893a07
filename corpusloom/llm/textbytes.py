"""Vectorised byte-level text kernels used inside Arrow tasks.

All functions take a run of UTF-8 texts laid end to end (``buf``) with their boundaries (``off``, one more than texts)
and work on whole texts. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one text longer than this is handled alone, whole.
SLICE_BYTES = 1 << 20

_RNG = np.random.RandomState(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = _RNG.randint(0, 1 << 62, 256, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z count as a-z
_PLACE = _RNG.randint(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE_BYTES), _powers(_INVERSE, SLICE_BYTES)

#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Terms are runs of ASCII letters, digits and bytes of other letters.
TERMS = np.zeros(256, dtype=bool)
TERMS[48:58] = TERMS[65:91] = TERMS[97:123] = TERMS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the boundaries of its texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, boundaries) of runs of whole texts of about ``limit`` bytes."""
    buf, off = text_bytes(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes of ``kind`` within one text."""
    inside = kind[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    first, last = off[:-1][full], off[1:][full] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(off, s, "right") - 1


def run_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, equal for runs that differ in the case of A-Z only."""
    if not len(s):
        return np.zeros(0, np.uint64)
    n = len(buf)
    up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(_BASE, n), _powers(_INVERSE, n))
    total = np.cumsum(_BYTE_CODE[buf] * up[:n], dtype=np.uint64)
    below = np.where(s > 0, total[s - 1], np.uint64(0))
    return mix((total[e - 1] - below) * down[s] ^ (e - s).astype(np.uint64) * _PLACE[6])


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of ``width``-word shingles of each text (A-Z lower-cased).

    A text with fewer words has the one shingle of its whole sequence; a text without words has none.
    """
    s, e, text = runs(buf, off, SPACED)
    words = run_hashes(buf, s, e)
    bounds = np.searchsorted(text, np.arange(len(off)))
    grams = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        grams[: len(words) - k] += words[k:] * _PLACE[k]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = np.sum(words[a:b] * _PLACE[: b - a], dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(b - a) * _PLACE[7]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
