"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Alphabets of at most so many symbols are induced bucket by bucket, larger ones suffix by suffix.
BUCKETS = 1_024


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix of t is smaller than the next one, and the leftmost-smaller positions.
    The end of t counts as a symbol smaller than all, so the last suffix is not smaller."""
    n = len(t)
    smaller = np.zeros(n, bool)
    turns = np.flatnonzero(t[:-1] != t[1:])
    if len(turns):
        rises = t[turns] < t[turns + 1]
        at = np.searchsorted(turns, np.arange(turns[-1] + 1))
        smaller[: turns[-1] + 1] = rises[at]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def induce(t: np.ndarray, smaller: np.ndarray, marks: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller positions induce (of substrings between them,
    where these are only known by their first symbols)."""
    return (_by_bucket if sigma <= BUCKETS else _by_suffix)(t, smaller, marks, sigma)


def _by_bucket(t, smaller, marks, sigma):
    """Whole buckets at a time: what a bucket induces in itself follows in further rounds."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    heads = np.concatenate([[0], ends[:-1]])
    starts, tails = heads.copy(), ends.copy()
    sa = np.empty(n, np.int64)

    def put(block: np.ndarray, up: bool) -> None:
        before = block[block > 0] - 1
        before = before[smaller[before] != up]
        symbols = t[before]
        order = np.argsort(symbols, kind="stable")
        sorted_symbols, before = symbols[order], before[order]
        firsts = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])) if len(order) else np.empty(0, np.int64)
        counts = np.diff(np.append(firsts, len(order)))
        rank = np.arange(len(order)) - np.repeat(firsts, counts)
        found = sorted_symbols[firsts]
        if up:
            sa[heads[sorted_symbols] + rank] = before
            heads[found] += counts
        else:
            sa[tails[sorted_symbols] - 1 - rank] = before
            tails[found] -= counts

    cuts = np.searchsorted(t[marks], np.arange(sigma + 1)) if len(marks) else np.zeros(sigma + 1, np.int64)
    put(np.array([n]), True)
    for c in range(sigma):
        done = starts[c]
        while done < heads[c]:
            block, done = sa[done : heads[c]].copy(), heads[c]
            put(block, True)
        if cuts[c] < cuts[c + 1]:
            put(marks[cuts[c] : cuts[c + 1]], True)
    for c in range(sigma - 1, -1, -1):
        done = ends[c]
        while tails[c] < done:
            block, done = sa[tails[c] : done][::-1].copy(), tails[c]
            put(block, False)
        if starts[c] < heads[c]:
            put(sa[starts[c] : heads[c]][::-1].copy(), False)
    return sa


def _by_suffix(t, smaller, marks, sigma):
    """One scan up and one down over all suffixes."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=sigma))
    heads, tails = np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()
    text, small = t.tolist(), smaller.tolist()
    sa = [-1] * n
    for p in reversed(marks.tolist()):
        tails[text[p]] -= 1
        sa[tails[text[p]]] = p
    sa[heads[text[-1]]] = n - 1
    heads[text[-1]] += 1
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = text[p]
            sa[heads[c]] = p
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = text[p]
            tails[c] -= 1
            sa[tails[c]] = p
    return np.array(sa, np.int64)


def names(t: np.ndarray, marks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings between leftmost-smaller positions marks, equal for equal ones and
    growing along order, the positions sorted by substring; in the order of marks."""
    width = np.append(marks[1:] - marks[:-1] + 1, 0)  # both ends count; the last one has no equal
    size = width[np.searchsorted(marks, order)]
    same = (size[1:] == size[:-1]) & (size[1:] > 0)
    pairs = np.flatnonzero(same)
    if len(pairs):
        length = size[pairs + 1]
        begin = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(begin, length)
        differ = t[np.repeat(order[pairs], length) + inside] != t[np.repeat(order[pairs + 1], length) + inside]
        same[pairs] = ~np.logical_or.reduceat(differ, begin)
    number = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(marks), np.int64)
    out[np.searchsorted(marks, order)] = number
    return out


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes of t in ascending order; symbols are whole numbers below sigma. Linear in
    len(t): leftmost-smaller substrings are sorted by induction, named and, where names repeat,
    sorted as suffixes of the string of names; from them all other suffixes are induced."""
    if len(t) < 2:
        return np.arange(len(t))
    smaller, marks = classify(t)
    if len(marks):
        rough = induce(t, smaller, marks[np.argsort(t[marks], kind="stable")], sigma)
        is_mark = np.zeros(len(t), bool)
        is_mark[marks] = True
        order = rough[is_mark[rough]]
        numbers = names(t, marks, order)
        most = int(numbers.max()) + 1
        if most < len(marks):
            order = marks[suffix_array(numbers, most)]
        marks = order
    return induce(t, smaller, marks, sigma)


#: Neighbouring positions of which one lane computes the common prefixes, one after the other.
LANE = 64


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of t (symbols below 2^16) the length of the common prefix, up to most, of its
    suffix and the one before it in sa, and where that one starts (-1: none). In text order a
    length falls by one at most, so a lane starts each comparison where the last one ended; all
    lanes walk side by side, four symbols at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate([t.astype(np.uint64), np.zeros(most + LANE + 8, np.uint64)])
    words = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    run = np.zeros(len(lanes), np.int64)
    for j in range(LANE):
        p = lanes[lanes + j < n] + j
        run = np.maximum(run[: len(p)] - 1, 0)
        q = before[p]
        run[q < 0] = 0
        todo = np.flatnonzero(q >= 0)
        while len(todo):
            at, to, l = p[todo], q[todo], run[todo]
            x = words[at + l] ^ words[to + l]
            more = (x & np.uint64(0xFFFF) == 0).astype(np.int64) + (x & np.uint64(0xFFFFFFFF) == 0) + (x & np.uint64(0xFFFFFFFFFFFF) == 0) + (x == 0)
            # neither suffix reaches beyond the end
            l = np.minimum(np.minimum(l + more, most), n - np.maximum(at, to))
            run[todo] = l
            todo = todo[(more == 4) & (l < most) & (np.maximum(at, to) + l < n)]
        out[p] = run
    return out, before
