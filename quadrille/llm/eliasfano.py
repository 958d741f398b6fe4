"""Elias-Fano lists of ascending integers, with select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sBxxxQQ")
#: One sample of the upper bits' select for so many values.
SAMPLE = 256


class EliasFano:
    """n ascending values below a universe in about n * (2 + log2(universe / n)) bits.

    The ``low`` bits of each value stand packed one after another; the rest is a unary
    bit vector in which the i-th one stands at (value >> low) + i. ``samples`` holds, for
    every 256th one, its place in 32 bits. No table of 64-bit offsets is kept.
    """

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        x = np.asarray(values, np.uint64)
        n = len(x)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if n > 1 and (x[1:] < x[:-1]).any():
            raise ValueError("values must ascend")
        low = max(0, (int(x[-1]) // n).bit_length() - 1)
        ones = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("a list holds fewer than 2**31 values; write more shards")
        upper = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(upper, ones // 8, (1 << (ones % 8)).astype(np.uint8))
        lower = np.zeros((n * low + 7) // 8, np.uint8)
        for k in range(low):
            at = np.arange(n, dtype=np.int64) * low + k
            on = at[((x >> np.uint64(k)) & np.uint64(1)).astype(bool)]
            np.bitwise_or.at(lower, on // 8, (1 << (on % 8)).astype(np.uint8))
        return cls(n, low, lower, upper, ones[::SAMPLE].astype(np.uint32))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low):
            at = i * self.low + k
            out |= ((self.lower[at // 8] >> (at % 8).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, bytes are counted until its one is reached."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, at // 8
        word = int(self.upper[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= rest:
            rest -= ones
            byte += 1
            word = int(self.upper[byte])
        for _ in range(rest):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.low) | int(self._lows(np.array([i]))[0])

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Values start..stop, decoded together from the samples around them."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint64)
        first = int(self.samples[start // SAMPLE]) // 8
        after = (stop + SAMPLE - 1) // SAMPLE
        last = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[first:last], bitorder="little")) + first * 8
        skip = start - start // SAMPLE * SAMPLE + int((ones < int(self.samples[start // SAMPLE])).sum())
        i = np.arange(start, stop)
        high = (ones[skip : skip + len(i)] - i).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._lows(i)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(b"EFL1", self.low, self.n, len(self.upper)) + self.lower.tobytes() + self.upper.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """A list and the place after it."""
        magic, low, n, wide = _HEAD.unpack_from(data, at)
        if magic != b"EFL1":
            raise ValueError("not an Elias-Fano list")
        at += _HEAD.size
        parts = []
        for kind, count in (("u1", (n * low + 7) // 8), ("u1", wide), ("<u4", (n + SAMPLE - 1) // SAMPLE)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low, *parts), at
