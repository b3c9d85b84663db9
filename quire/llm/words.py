"""Words of whole Arrow batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text, one row at least."""
    ends = np.asarray(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64).cumsum()
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield first, last
        first = last


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row number of every word of the texts, in order.

    Words are runs of anything but ASCII white space; a null text has none.
    """
    rows = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, rows.offset * 8)
    start, end = int(offsets[0]), int(offsets[-1])
    if start == end:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(rows.buffers()[2], np.uint8, end - start, start)
    offsets = offsets - start
    solid = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    first = np.flatnonzero(solid & (~before | border[:-1]))
    last = np.flatnonzero(solid & (~after | border[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), (BYTE[data] * powers(ODD, len(data))[:-1]).cumsum(dtype=np.uint64)])
        value = (total[last] - total[first]) * powers(INVERSE, len(data))[first]
    return mix(value + (last - first).astype(np.uint64)), np.searchsorted(offsets, first, "right") - 1


def run_hash(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of every run of ``n`` words (``len(words) - n + 1`` of them)."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            total = total * np.uint64(base) + words[i:i + len(total)]
    return mix(total)
