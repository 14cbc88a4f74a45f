"""Vectors in Arrow columns as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None if it is null or holds null or non-finite components."""
    if not len(column):
        return []
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    fine = np.isfinite(flat)
    ends = column.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok and fine[a:b].all() else None for a, b, ok in zip(ends[:-1], ends[1:], known)]
