"""Elias-Fano sequences over numpy arrays, and a trie of n-grams made of them."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary. Arrays may be memory-mapped."""

    def __init__(self, parts: dict[str, np.ndarray], name: str = ""):
        self.low, self.high, self.before, meta = (parts[f"{name}{x}"] for x in (".low", ".high", ".before", ".meta"))
        self.n, self.width = int(meta[0]), int(meta[1])

    @staticmethod
    def build(values: np.ndarray, name: str = "") -> dict[str, np.ndarray]:
        v = np.asarray(values, np.uint64)
        n = len(v)
        most = int(v[-1]) + 1 if n else 1
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        words = (int(high[-1]) // 64 if n else 0) + 1
        bits = np.zeros(words, np.uint64)
        np.bitwise_or.at(bits, high >> 6, _ONE << (high & 63).astype(np.uint64))
        low = np.zeros((n * width) // 64 + 2, np.uint64)
        if width:
            x = v & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, x << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, x[over] >> (np.uint64(64) - shift[over]))
        before = np.zeros(words + 1, np.uint32)
        np.cumsum(np.bitwise_count(bits), out=before[1:])
        return {f"{name}.low": low, f"{name}.high": bits, f"{name}.before": before, f"{name}.meta": np.array([n, width], np.int64)}

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions i."""
        i = np.asarray(i, np.int64)
        w = np.searchsorted(self.before, i.astype(self.before.dtype), "right") - 1
        return self._joined(w * 64 + placed(self.high[w], i - self.before[w]) - i, i)

    def all(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return self._joined(places - i, i)

    def _joined(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        return high << self.width | self._lows(i)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits at the positions i."""
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        shift = (at & 63).astype(np.uint64)
        x = self.low[at >> 6] >> shift
        x |= np.where(shift > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (x & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def find(self, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The position in [start, end) that holds value, or -1. Values rise within a range, and
        value is at least that before start: its high bits name the zero behind which to look."""
        high, low = value >> self.width, value & ((1 << self.width) - 1)
        lo, hi = np.maximum(start, self._upto(high - 1)), np.minimum(end, self._upto(high))
        todo = np.flatnonzero(lo < hi)
        at, to, want = lo[todo], hi[todo], low[todo]
        for _ in range(int((to - at).max(initial=1)).bit_length()):
            mid = (at + to) >> 1
            below = (self._lows(mid) < want) & (at < to)
            at, to = np.where(below, mid + 1, at), np.where(below, to, mid)
        out = np.full(len(value), -1, np.int64)
        hit = np.flatnonzero(at < hi[todo])
        hit = hit[self._lows(at[hit]) == want[hit]]
        out[todo[hit]] = at[hit]
        return out

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits up to these."""
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        out = np.where(high < 0, 0, self.n)
        inside = np.flatnonzero((high >= 0) & (high < zeros[-1]))
        zero = high[inside]
        w = np.searchsorted(zeros, zero, "right") - 1
        out[inside] = w * 64 + placed(~self.high[w], zero - zeros[w]) - zero
        return out


def placed(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where in each word of bits the one lies that has left ones below it."""
    place = np.zeros(len(bits), np.int64)
    left = np.asarray(left, np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(bits & np.uint64((1 << s) - 1)).astype(np.int64)
        go = left >= c
        left = np.where(go, left - c, left)
        bits = np.where(go, bits >> np.uint64(s), bits)
        place += go * s
    return place


def quantised(x: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: values in bins of equal counts, each bin at its mean."""
    x = np.asarray(x, np.float64)
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    values, place = np.unique(x, return_inverse=True)
    if len(values) <= 1 << bits:
        return place.astype(np.uint8), values
    order = np.argsort(x, kind="stable")
    code = np.empty(len(x), np.uint8)
    code[order] = (np.arange(len(x)) << bits) // len(x)
    n = np.bincount(code, minlength=1 << bits)
    return code, np.bincount(code, x, minlength=1 << bits) / np.maximum(n, 1)


class Level:
    """One shard of a level of the trie: a range of contexts and the words that follow each.

    Pointers from contexts to their lists and the lists themselves (each list's numbers follow
    on from the last of the list before, so that they are monotone together) are Elias-Fano
    sequences; log10 probabilities of n-grams and back-off weights of contexts are 8-bit codes.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.to, self.list = EliasFano(parts, "to"), EliasFano(parts, "list")
        self.code = {k: (parts[f"{k}.code"], parts[f"{k}.book"]) for k in ("p", "b")}
        self.counts = parts["n"]

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, n: np.ndarray, p: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """context, word: sorted; context counts from 0 to the length of weight. n, p: counts and
        probabilities of n-grams; weight: of contexts."""
        begin = np.searchsorted(context, np.arange(len(weight) + 1))
        filled = begin[1:] > begin[:-1]
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, begin[1:][filled], word[begin[1:][filled] - 1])
        out = {"n": n.astype(np.int64)}
        for k, x in (("p", p), ("b", weight)):
            out[f"{k}.code"], out[f"{k}.book"] = quantised(np.log10(np.maximum(x, 1e-12)))
        return out | EliasFano.build(begin, "to") | EliasFano.build(word + np.cumsum(step)[:-1], "list")

    def value(self, kind: str, at: np.ndarray) -> np.ndarray:
        code, book = self.code[kind]
        return book[code[at]]

    def keys(self, width: int) -> np.ndarray:
        """context * width + word of all n-grams."""
        begin, numbers = self.to.all(), self.list.all()
        later = np.flatnonzero((begin[:-1] > 0) & (begin[1:] > begin[:-1]))
        base = np.zeros(len(begin) - 1, np.int64)
        base[later] = numbers[begin[later] - 1]
        context = np.repeat(np.arange(len(base)), np.diff(begin))
        return context * width + numbers - base[context]

    def find(self, keys: np.ndarray, width: int) -> np.ndarray:
        """Positions of sorted keys, -1 where absent. Many keys are searched in the level read
        from end to end, few by the pointers."""
        if 4 * len(keys) >= self.list.n:
            mine = self.keys(width)
            at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
            return np.where(mine[at] == keys, at, -1)
        context, word = keys // width, keys % width
        run = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        start, end = self.to.at(context[run]), self.to.at(context[run] + 1)
        base = np.zeros(len(run), np.int64)
        later = np.flatnonzero((start > 0) & (start < end))
        base[later] = self.list.at(start[later] - 1)
        start, end, base = (np.repeat(x, np.diff(np.r_[run, len(keys)])) for x in (start, end, base))
        return self.list.find(start, end, base + word)
