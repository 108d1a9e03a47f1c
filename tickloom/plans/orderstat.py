"""Order statistics of sliding frames over one array, by a wavelet matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def count_below(keys: np.ndarray, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each query, how many of ``keys[first:end]`` are under ``bound``; keys are whole numbers from 0.

    Bit by bit from the highest: keys are dealt stably into those without and with the bit, prefix counts tell where
    each query's stretch goes, and a bound with the bit counts all keys of its stretch without it.
    """
    out = np.zeros(len(first), np.int64)
    keys, first, end = keys.copy(), first.copy(), end.copy()
    top = int(max(keys.max(initial=0), bound.max(initial=0)))
    for bit in reversed(range(top.bit_length())):
        has = (keys >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~has)))
        a, b = zeros[first], zeros[end]
        up = (bound >> bit) & 1 == 1
        out += np.where(up, b - a, 0)
        first, end = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + end - b, b)
        keys = np.concatenate((keys[~has], keys[has]))
    return out


def trailing_ranks(values: pa.ChunkedArray, n: int) -> pa.Array:
    """Tie-averaged rank of each value among the known ones of the last ``n`` places, over their number; null for null."""
    known = values.is_valid().to_numpy()
    x = values.drop_null().to_numpy()
    if not len(x):
        return pa.nulls(len(known), pa.float64())
    order = np.argsort(x, kind="stable")
    steps = np.concatenate(([False], x[order][1:] != x[order][:-1]))
    key = np.empty(len(x), np.int64)
    key[order] = np.cumsum(steps)
    before = np.concatenate(([0], np.cumsum(known)))
    at = np.flatnonzero(known)
    first, end = before[np.maximum(at - n + 1, 0)], before[at + 1]
    below = count_below(key, first, end, key)
    upto = count_below(key, first, end, key + 1)
    out = np.zeros(len(known))
    out[at] = (below + (upto - below + 1) / 2) / (end - first)
    return pa.array(out, mask=~known)
