"""Hilbert keys of points in a few dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of grid points (rows of whole numbers below 2**bits; dimensions * bits up to 63).

    The axes are brought into the curve's local frame bit by bit, from the highest down, by exchanges and
    inversions; a Gray decoding and an interleaving of the bits give the key.
    """
    x = grid.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)
