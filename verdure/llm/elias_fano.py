"""Elias-Fano code of ascending numbers with select by numpy.

A number's low bits are stored as they are; its high part ``h`` of the ``i``-th number sets bit ``h + i``. A count of
set bits before every 512 bits makes select a search among these counts and a look at eight words. ``n`` numbers up
to ``u`` take about ``n * (2.4 + log2(u / n))`` bits.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB7x")
_BLOCK = 8  # 64-bit words between two counts


def encode(values: np.ndarray) -> bytes:
    """Code of ascending non-negative numbers; equal neighbours are allowed."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    words = -(-(int(high[-1]) + 1 if n else 0) // 64)
    words = -(-words // _BLOCK) * _BLOCK
    bits = np.zeros(words * 64, np.uint8)
    bits[high] = 1
    packed = np.packbits(bits, bitorder="little")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, _BLOCK * 64).sum(axis=1, dtype=np.int64))])
    low = values & np.uint64((1 << low_bits) - 1)
    lows = np.packbits((low[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little")
    return _HEAD.pack(n, words, low_bits) + packed.tobytes() + ones.astype("<u8").tobytes() + lows.tobytes()


class EliasFano:
    """Reads single numbers out of a code without expanding it."""

    def __init__(self, code: bytes):
        self.n, words, self.low_bits = _HEAD.unpack_from(code)
        at = _HEAD.size
        self.words = np.frombuffer(code, "<u8", words, at).reshape(-1, _BLOCK)
        at += words * 8
        self.ones = np.frombuffer(code, "<u8", words // _BLOCK + 1, at).astype(np.int64)
        at += (words // _BLOCK + 1) * 8
        self.lows = np.frombuffer(code, np.uint8, -(-self.n * self.low_bits // 8), at)

    def __getitem__(self, index) -> np.ndarray:
        """The numbers at the given places (an array of places)."""
        k = np.atleast_1d(np.asarray(index, np.int64))
        if len(k) == 0:
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ones, k, side="right") - 1
        rest = k - self.ones[block]
        rows = self.words[block]
        before = np.cumsum(np.bitwise_count(rows), axis=1, dtype=np.int64)
        word = (before <= rest[:, None]).sum(axis=1)
        line = np.arange(len(k))
        rest -= np.where(word > 0, before[line, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(rows[line, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        high = block * _BLOCK * 64 + word * 64 + bit - k
        return (high << self.low_bits) | self._low(k)

    def _low(self, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k), np.int64)
        for j in range(self.low_bits):
            at = k * self.low_bits + j
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << j
        return out
