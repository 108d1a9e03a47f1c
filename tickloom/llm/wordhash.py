"""Words of many texts and 64-bit hashes of their n-grams, computed over whole buffers with NumPy.

A hash of words i..j is a difference of prefix sums of a polynomial modulo 2^64, so any n-gram of any length
costs the same. Operators that need exactness pair two independent hashes or compare the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << (max(n, 2) - 1).bit_length()
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class Prefix:
    """Hashes of any run of ``values``."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        up, self.down = _table(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Words:
    """Words of ``texts``: ``hash`` of each, ``doc`` it is in, and ``first``, where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = _SPACE[buf]
        turn = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.hash = Prefix(_BYTE[buf]).run(self.starts, self.ends)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.first = np.concatenate(([0], np.searchsorted(self.starts, ends)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def windows(self, n: int) -> np.ndarray:
        """Starts of the n-word windows that lie in one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as bytes (none for null), about ``CHUNK_BYTES`` at a time."""
    for batch in batches:
        texts = [b"" if t is None else t for t in batch.column(text).cast(pa.large_binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    low = x
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
