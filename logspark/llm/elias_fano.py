"""Elias-Fano coding of ascending numbers, with select.

``n`` numbers below ``universe`` take ``low`` bits each as they stand, with
``low = floor(log2(universe / n))``, and the rest as a row of bits in which
the i-th one stands at ``(value >> low) + i``: about ``2 + low`` bits a number.
Every ``SAMPLE``-th one's place is noted, so ``select`` looks at a short
stretch of bits only.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQB7x")                            # n, bits of the high row, low


def _bits(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    flat = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray, universe: int) -> bytes:
    """Ascending values (repeats allowed) of 0 <= value < universe <= 2**64."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = int(places[-1]) + 1 if n else 0
    high = np.zeros(size, np.uint8)
    high[places] = 1
    return (_HEAD.pack(n, size, low) + _bits(values & np.uint64((1 << low) - 1), low)
            + np.packbits(high, bitorder="little").tobytes() + places[::SAMPLE].astype("<u4").tobytes())


class EliasFano:
    """Reads what ``encode`` wrote at ``data[at:]``; ``end`` is where it ends."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, size, self.low = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        lows, highs, samples = -(-self.n * self.low // 8), -(-size // 8), -(-self.n // SAMPLE)
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.highs = np.frombuffer(data, np.uint8, highs, at + lows)
        self.samples = np.frombuffer(data, "<u4", samples, at + lows + highs)
        self.end = at + lows + highs + 4 * samples

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first = i * self.low
        part = self.lows[first >> 3:(first + self.low + 7) >> 3].tobytes()
        return (int.from_bytes(part, "little") >> (first & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        ahead = int(self.highs[byte]) >> (place & 7) << (place & 7)   # from the noted one on
        while (ones := ahead.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            ahead = int(self.highs[byte])
        for _ in range(left):
            ahead &= ahead - 1
        return (byte * 8 + (ahead & -ahead).bit_length() - 1 - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        """All numbers (uint64)."""
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def first_not_below(self, value: int) -> int:
        """How many numbers are below ``value``."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            if self.select(mid) < value:
                lo = mid + 1
            else:
                hi = mid
        return lo
