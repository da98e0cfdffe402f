"""Hilbert curve positions of many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the curve of each row of ``points`` (unsigned integers below 2 ** bits), as uint64.

    Skilling's transform, column by column, over all rows together; dims * bits must not exceed 63.
    """
    x = [c.astype(np.uint64) for c in points.T]
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > 1:
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= one
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(len(points), np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x = [c ^ t for c in x]
    out = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << one) | ((c >> np.uint64(b)) & one)
    return out
