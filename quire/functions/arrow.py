"""Parts of Arrow batches.

How many rows or bytes an Arrow batch has is a setting of the session. Python
stages go through it in parts of bounded size and hand out each part by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES, PART_ROWS = 1 << 20, 1024


def by_bytes(texts: pa.Array, most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[pa.Array]:
    """The texts in runs of about ``most`` bytes and at most ``rows`` rows, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        base = ends[first - 1] if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, base + most, "right"))), first + rows)
        yield texts.slice(first, last - first)
        first = last
