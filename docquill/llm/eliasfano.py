"""Elias-Fano sequences over numpy: compact, memory-mapped, searched for successors many at a time."""

from __future__ import annotations

import numpy as np

# SELECT[b, k]: place of the k-th set bit of byte b.
SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        SELECT[_b, _k] = _at
FIVES, THREES, NIBBLES, ONES, TOPS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))  # a byte, eight times
CHUNK = 1 << 14  # what is looked up at once, so that it stays in the caches


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low `width` bits of each value, one after another; a spare word at the end."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    if not width or not n:
        return out
    for i in range(0, n, CHUNK):
        v = values[i : i + CHUNK].astype(np.uint64) & np.uint64((1 << width) - 1)
        at = np.arange(i, i + len(v), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, v << shift)
        over = shift.astype(np.int64) + width > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    return window(words, word, shift) & np.uint64((1 << width) - 1)


def window(words: np.ndarray, word: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The 64 bits from a place on."""
    return (words[word] >> shift) | ((words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))


def selected(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th ones of words, by sums of their bytes within the word."""
    one = np.uint64(1)
    sums = words - ((words >> one) & FIVES)
    sums = (sums & THREES) + ((sums >> np.uint64(2)) & THREES)
    sums = ((sums + (sums >> np.uint64(4))) & NIBBLES) * ONES  # in each byte the ones up to its end
    byte = np.bitwise_count((((k * ONES) | TOPS) - sums) & TOPS).astype(np.uint64) << np.uint64(3)
    rest = k - (((sums << np.uint64(8)) >> byte) & np.uint64(255))
    return byte.astype(np.int64) + SELECT[((words >> byte) & np.uint64(255)).astype(np.int64), rest.astype(np.int64)]


class EliasFano:
    """A sorted sequence of n integers below `universe`: low bits packed, high parts in unary (a one for each value, a
    zero for each step of the high part), with running counts of zeros and ones by 64-bit word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (universe >> width) + n + 2
        high = np.zeros(bits // 64 + 2, np.uint64)  # a spare word at the end
        for i in range(0, n, CHUNK):
            at = values[i : i + CHUNK].astype(np.uint64) >> np.uint64(width)
            at += np.arange(i, i + len(at), dtype=np.uint64)
            np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return cls(n, width, pack(values, width), high, np.arange(len(ones), dtype=np.int64) * 64 - ones, ones)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros, self.ones]

    def bytes(self) -> int:
        return sum(a.nbytes for a in self.arrays())

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones or zeros of the high bits."""
        counts = self.ones if one else self.zeros
        word = np.searchsorted(counts, k, "right") - 1
        return word * 64 + selected(self.high[word] if one else ~self.high[word], (k - counts[word]).astype(np.uint64))

    def get(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        out = np.empty(len(index), np.uint64)
        for i in range(0, len(index), CHUNK):
            part = index[i : i + CHUNK]
            top = (self.select(part, True) - part).astype(np.uint64)
            out[i : i + CHUNK] = (top << np.uint64(self.width)) | unpack(self.low, self.width, part)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x in the sequence, or -1; fastest for ascending ones, which touch the sequence in its order."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        for i in range(0, len(x) if self.n else 0, CHUNK):
            self._find(x[i : i + CHUNK], out[i : i + CHUNK])
        return out

    def _find(self, x: np.ndarray, out: np.ndarray) -> None:
        """The values of x's high part lie between two zeros of the high bits; these few are gone through by their low bits."""
        inside = (x >> np.uint64(self.width)) < np.uint64(self.zeros[-2])  # others are beyond the universe
        if not inside.all():
            within = np.full(int(inside.sum()), -1, np.int64)
            if len(within):
                self._find(x[inside], within)
            out[inside] = within
            return
        top = (x >> np.uint64(self.width)).astype(np.int64)
        low = x & np.uint64((1 << self.width) - 1)
        bit = np.where(top > 0, self.select(np.maximum(top - 1, 0), False) + 1, 0)
        begin = bit - top
        ones = window(self.high, bit >> 6, (bit & 63).astype(np.uint64))
        run = np.bitwise_count(ones & ~(ones + np.uint64(1))).astype(np.int64)  # ones before the next zero
        long = np.nonzero(run == 64)[0]
        run[long] = self.select(top[long], False) - bit[long]
        end = begin + run
        lo, hi = begin.copy(), end.copy()  # binary search for the first low part at or above
        open_ = np.nonzero(lo < hi)[0]
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpack(self.low, self.width, mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        hit = np.nonzero(lo < end)[0]
        hit = hit[unpack(self.low, self.width, lo[hit]) == low[hit]]
        out[hit] = lo[hit]
