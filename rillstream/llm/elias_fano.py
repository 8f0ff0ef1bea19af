"""Elias-Fano sequences and a two-level n-gram trie of them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

_U = np.uint64
_ONE = np.uint64(1)


class EliasFano:
    """A monotone sequence of ``n`` integers under 2**63: low bits packed, high bits in unary, and a count of zeros for each 64 bits.

    ``find`` takes many values at once: the high part leads, by select over zeros, to the few elements that share
    it, and a binary search among their low parts ends at the successor.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(_U)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits:
            at = np.arange(n, dtype=_U) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            part = values & _U((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + _U(bits)) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        place = (values >> _U(bits)) + np.arange(n, dtype=_U)
        size = (top >> bits) + n + 2
        high = np.zeros(size // 64 + 1, _U)
        np.bitwise_or.at(high, (place >> _U(6)).astype(np.int64), _ONE << (place & _U(63)))
        each = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.concatenate(([0], np.cumsum(each))))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        (n, bits), low, high, zeros = arrays
        return cls(int(n), int(bits), low, high, zeros)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i.astype(_U) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        out = self.low[word] >> shift
        over = (shift + _U(self.bits)) > _U(64)
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number ``k`` (from 0)."""
        word = np.searchsorted(self.zeros, k, side="right") - 1
        left = (k - self.zeros[word]).astype(np.int64)
        bits = ~self.high[np.minimum(word, len(self.high) - 1)]
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & _U((1 << width) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            go = left >= n
            left = np.where(go, left - n, left)
            place += go * width
            bits = np.where(go, bits >> _U(width), part)
        return place

    def _select1(self, i: np.ndarray) -> np.ndarray:
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        word = np.searchsorted(ones, i, side="right") - 1
        left = i - ones[word]
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        place = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & _U((1 << width) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            go = left >= n
            left = np.where(go, left - n, left)
            place += go * width
            bits = np.where(go, bits >> _U(width), part)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at the places ``i``."""
        return ((self._select1(i) - i).astype(_U) << _U(self.bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of each value's successor, between ``first`` and ``stop`` if given, and whether it is the value itself."""
        x = x.astype(_U)
        none = np.zeros(len(x), bool)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), none
        h = (x >> _U(self.bits)).astype(np.int64)
        inside = h < int(self.zeros[-1]) - 1
        h = np.where(inside, h, 0)
        lo = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        hi = self._select0(h) - h
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, stop)
        want = x & _U((1 << self.bits) - 1)
        end = hi.copy()
        live = np.flatnonzero((lo < hi) & inside)
        while live.size:
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        found = inside & (lo < end)
        at = np.flatnonzero(found)
        found[at] = self._low(lo[at]) == want[at]
        return np.where(inside, lo, self.n), found


#: Levels of quantised values, evenly spaced between the least and the largest.
LEVELS = 4096
#: Bits of a successor's hash that the second level keeps.
SUCCESSOR = 40


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    step = (high - low) / (LEVELS - 1) or 1.0
    return np.rint((values - low) / step).astype(np.uint16), np.array([low, step])


class Trie:
    """Contexts (level one), and their successors (level two) in ranges that monotone pointers give.

    A context is the upper 63 bits of a word's hash. A successor is kept relative to its context: the context's rank, times
    2**``SUCCESSOR``, plus the upper bits of the successor's hash, which makes the whole level one monotone sequence. Both levels
    carry quantised logarithms: a context its backoff weight, a successor its smoothed probability.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, backoff, probability):
        self.contexts, self.pointers, self.successors = contexts, pointers, successors
        self.backoff, self.probability = backoff, probability

    @classmethod
    def of_counts(cls, contexts: np.ndarray, totals: np.ndarray, rank: np.ndarray, successor: np.ndarray, n: np.ndarray, discount: float) -> Trie:
        """From contexts (hashes, ascending) with their totals, and pairs (context's rank, successor's hash; ascending) with their counts."""
        pairs = (rank.astype(_U) << _U(SUCCESSOR)) | (successor >> _U(64 - SUCCESSOR))
        new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.empty(0, np.int64)
        n = np.add.reduceat(n, new) if len(pairs) else n
        rank, pairs = rank[new], pairs[new]
        kinds = np.bincount(rank, minlength=len(contexts))
        backoff = np.log10(discount * kinds / totals) if len(contexts) else np.empty(0)
        probability = np.log10((n - discount) / totals[rank]) if len(contexts) else np.empty(0)
        pointers = np.concatenate(([0], np.cumsum(kinds)))
        return cls(EliasFano.build(contexts >> _ONE), EliasFano.build(pointers), EliasFano.build(pairs), quantise(backoff), quantise(probability))

    def look_up(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each context, and whether it is there."""
        return self.contexts.find(context >> _ONE)

    def kinds(self, rank: np.ndarray) -> np.ndarray:
        """Number of different successors of contexts."""
        return (self.pointers.get(rank + 1) - self.pointers.get(rank)).astype(np.int64)

    def score(self, rank: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each pair that is there, the context's backoff weight of the others; and whether it is there."""
        first, stop = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
        at, found = self.successors.find((rank.astype(_U) << _U(SUCCESSOR)) | (successor >> _U(64 - SUCCESSOR)), first, stop)
        (p, (p0, dp)), (b, (b0, db)) = self.probability, self.backoff
        out = b0 + db * b[rank].astype(float)
        out[found] = p0 + dp * p[at[found]]
        return out, found

    def arrays(self) -> list[np.ndarray]:
        return [a for e in (self.contexts, self.pointers, self.successors) for a in e.arrays()] + [*self.backoff, *self.probability]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Trie:
        e = [EliasFano.of(arrays[k : k + 4]) for k in (0, 4, 8)]
        return cls(*e, (arrays[12], arrays[13]), (arrays[14], arrays[15]))

    def mapped(self, folder: str | None = None) -> Trie:
        """The same trie over a memory-mapped file without a name, which goes with the last reference to it."""
        arrays = self.arrays()
        fd, path = tempfile.mkstemp(dir=folder)
        os.unlink(path)
        with os.fdopen(fd, "wb") as f:
            places = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(a.tobytes())
            f.write(b"\0" * 8)
            f.flush()
            level = mmap.mmap(fd, 0, access=mmap.ACCESS_READ)
        return Trie.of([np.frombuffer(level, a.dtype, len(a), at) for a, at in zip(arrays, places)])
