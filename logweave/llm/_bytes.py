"""Byte-level helpers for numpy inside Arrow tasks: texts as one buffer, words, rolling hashes.

Every helper takes a block of whole texts, never a prefix; blocks are cut so that the arrays over
a block stay small, and a text longer than a block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
POWER_BITS = 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_SYMBOL = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of successive blocks of at most `limit` bytes, or of one text."""
    data, offsets = texts(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`, cut at text borders, and each text's offset among the runs."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(base: np.uint64, at: np.ndarray | int) -> np.ndarray:
    """base to the power of each number in `at`, or of 0 .. at - 1; tables of a fixed size serve texts of any length."""
    name = f"{base}"
    if name not in _POWERS:
        for key, step in ((name, base), (f"{name} far", np.uint64(pow(int(base), 1 << POWER_BITS, 1 << 64)))):
            steps = np.full(1 << POWER_BITS, step, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    near, far = _POWERS[name], _POWERS[f"{name} far"]
    if isinstance(at, int):
        return near[:at] if at <= len(near) else (far[: (at - 1 >> POWER_BITS) + 1, None] * near).reshape(-1)[:at]
    return near[at & (len(near) - 1)] * far[at >> POWER_BITS]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes (or 64-bit symbols) wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_SYMBOL[data] if data.dtype == np.uint8 else data) * _powers(_PRIME, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, starts) + (ends - starts).astype(np.uint64))


def string_hash(text: str | bytes) -> int:
    """span_hashes of one string."""
    data = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to, from each text's offset among the items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
