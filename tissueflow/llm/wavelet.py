"""A wavelet matrix over token ids: one bit-plane per bit, each with a rank directory.

Plane l holds bit l (from the top) of every id, in the order that a stable sort by the bits above gives.
access, rank and select each walk the planes once; decode turns all planes back into ids.
"""

from __future__ import annotations

import numpy as np

#: A rank sample stands for so many bits.
SAMPLE = 512


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[bytes], zeros: list[int], samples: list[bytes] | None = None):
        self.n, self.bits, self.zeros = n, bits, list(zeros)
        self.planes = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.samples = [np.frombuffer(s, dtype=np.uint32) for s in samples] if samples else [self._sampled(p) for p in self.planes]

    @staticmethod
    def _sampled(plane: np.ndarray) -> np.ndarray:
        """Ones before each group of SAMPLE bits."""
        step = SAMPLE // 8
        padded = np.zeros(-(-len(plane) // step) * step, dtype=np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        """ids below 2 ** bits; an empty array gives empty planes."""
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(one, bitorder="little").tobytes())
            low = np.compress(~one, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(one, now)])
        return cls(len(ids), bits, planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        place = np.arange(self.n, dtype=np.int32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little")
            ones = np.cumsum(one, dtype=np.int32)
            zero_at = place - ones
            # where each id went in the stable partition, without a branch for each bit
            went = zero_at + one * (ones + np.int32(self.zeros[k] - 1) - zero_at)
            now = now.take(went)
            now |= one.astype(now.dtype) << now.dtype.type(self.bits - 1 - k)
        return now.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        group = i // SAMPLE
        a = group * (SAMPLE // 8)
        whole, rest = divmod(i - group * SAMPLE, 8)
        got = int(self.samples[k][group]) + int(np.bitwise_count(self.planes[k][a : a + whole]).sum())
        return got + (int(self.planes[k][a + whole]) & ((1 << rest) - 1)).bit_count() if rest else got

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            bit = (int(self.planes[k][i // 8]) >> (i % 8)) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if symbol >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i ids."""
        if symbol >> self.bits:
            return 0
        a, b = self._span(symbol, 0, i)
        return b - a

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        groups = self.samples[k].astype(np.int64)
        if not bit:
            groups = np.minimum(np.arange(len(groups)) * SAMPLE, self.n) - groups
        g = int(np.searchsorted(groups, j, side="right")) - 1
        a = g * (SAMPLE // 8)
        some = np.unpackbits(self.planes[k][a : a + SAMPLE // 8], bitorder="little")
        return g * SAMPLE + int(np.flatnonzero(some == bit)[j - int(groups[g])])

    def select(self, symbol: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of symbol; -1 if there are not so many."""
        if symbol >> self.bits or not 0 <= j < self.rank(symbol, self.n):
            return -1
        i = self._span(symbol, 0, self.n)[0] + j
        for k in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i
