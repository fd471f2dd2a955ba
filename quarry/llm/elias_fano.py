"""Elias-Fano coding of a non-decreasing sequence.

Each value keeps its lowest ``low`` bits in a packed array; the rest is coded
in unary in a bit vector in which value i sets bit ``(v_i >> low) + i``.  With
``low = floor(log2(universe / n))`` that is at most two bits a value beyond the
low bits.  Every ``SAMPLE``-th set bit's place is stored, so ``select`` reads a
bounded stretch of the vector from the nearest sample.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxI")  # values, universe, low bits, bytes of the bit vector


BATCH = 1 << 14  # values packed at once; a multiple of 8, so that each part ends on a byte


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    places = np.arange(width, dtype=np.uint64)
    parts = [((values[k: k + BATCH, None] >> places) & np.uint64(1)).astype(np.uint8) for k in range(0, len(values), BATCH)]
    return b"".join([np.packbits(p.ravel(), bitorder="little").tobytes() for p in parts])


def _unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    out, weight = np.zeros(n, np.int64), 1 << np.arange(width, dtype=np.int64)
    for k in range(0, n, BATCH):
        m = min(BATCH, n - k)
        bits = np.unpackbits(data[k * width // 8:], bitorder="little", count=m * width)
        out[k: k + m] = bits.reshape(m, width) @ weight
    return out


def encode(values: np.ndarray) -> bytes:
    """Bytes of the coded sequence; ``values`` must be non-decreasing and not negative."""
    v = np.asarray(values).astype(np.uint64)
    n = len(v)
    universe = int(v[-1]) + 1 if n else 1
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    lows = _pack(v & np.uint64((1 << low) - 1), low)
    return b"".join([_HEAD.pack(n, universe, low, len(high)), ones[::SAMPLE].astype("<u4").tobytes(), high, lows])


class EliasFano:
    """Reader over the bytes of :func:`encode` (no copy is made)."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, self.universe, self.low, high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        self.high = np.frombuffer(data, np.uint8, high, at)
        at += high
        size = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, size, at)
        self.end = at + size
        self._ones = self._first = self._words = None  # places of set bits, first index of each high part: made when asked for

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        a = i * self.low
        chunk = int.from_bytes(self.lows[a >> 3: (a + self.low + 7) >> 3].tobytes(), "little")
        return (chunk >> (a & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value i, read from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return ((one - i) << self.low) | self._low(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the values ``i``, read where they are packed."""
        if not self.low:
            return np.zeros(len(i), np.int64)
        if self._words is None:
            padded = np.concatenate([self.lows, np.zeros(16, np.uint8)])
            self._words = np.ndarray((len(self.lows) + 8,), "<u8", padded, 0, (1,))  # the eight bytes from each byte on
        a = i * self.low
        shift = (a & 7).astype(np.uint64)
        out = self._words[a >> 3] >> shift
        if self.low > 57:
            out |= (self._words[(a >> 3) + 8] << np.uint64(1)) << (np.uint64(63) - shift)
        return (out & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values ``i``."""
        if self._ones is None:
            self._ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((self._ones[i] - i) << self.low) | self._lows(i)

    def find(self, values: np.ndarray, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> np.ndarray:
        """Index of each value among those from ``low`` to before ``high``, -1 where it is not; of a strictly ascending sequence.

        The unary part gives the stretch with the value's high bits; in the
        part of it between the bounds, packed low bits are compared.
        """
        if self._first is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[: len(self.high) * 8 if self.n else 0] == 0)
            self._first = np.concatenate([[0], np.minimum(zeros - np.arange(len(zeros)), self.n), [self.n]])
        top = np.minimum(values >> self.low, len(self._first) - 2)
        a = np.maximum(self._first[top], low)
        b = np.minimum(self._first[top + 1], self.n if high is None else high)
        out = np.full(len(values), -1)
        k = np.flatnonzero((a < b) & (values >> self.low == top))
        a, b, want, index = a[k], b[k], values[k] & ((1 << self.low) - 1), k
        while len(index):
            middle = (a + b) >> 1
            got = self._lows(middle)
            out[index[got == want]] = middle[got == want]
            a, b = np.where(got < want, middle + 1, a), np.where(got > want, middle, b)
            k = np.flatnonzero((got != want) & (a < b))
            a, b, want, index = a[k], b[k], want[k], index[k]
        return out

    def values(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low
        if self.low:
            out += _unpack(self.lows, self.low, self.n)
        return out
