"""Words of many texts at once, as 64-bit hashes, with numpy.

A word's hash is a polynomial over a random table of its (lower-cased) bytes modulo 2**64, read off one running
sum over the whole buffer, then mixed. Words are runs of anything but ASCII white space, so bytes of UTF-8 do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
#: A random odd base with its inverse modulo 2**64, and random values of bytes.
_BASE = np.uint64(np.random.default_rng(20240501).integers(1, 2**63, dtype=np.uint64) * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_TABLE = np.random.default_rng(20240502).integers(1, 2**63, size=256, dtype=np.uint64)[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def spans_of(cuts: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all runs of solid bytes, cut where texts end."""
    edge = np.zeros(len(solid) + 1, dtype=bool)
    edge[cuts] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    return starts, np.flatnonzero(solid & (~after | edge[1:])) + 1


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words data[starts[i]:ends[i]]."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[:n], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end) of the texts data[cuts[i]:cuts[i + 1]]."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(cuts), np.int64)
    starts, ends = spans_of(cuts, ~_SPACE[data])
    return hashes_of(data, starts, ends), np.searchsorted(starts, cuts)


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, cuts) of a string column without nulls, some MB at a time; a long text is a slice of its own."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + most, side="right")) - 1)
        yield lo, hi, data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo]
        lo = hi


def shingles_of(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of one text's word windows; the whole sequence as one if it is shorter; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, size)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    return np.unique(mixed(out))
