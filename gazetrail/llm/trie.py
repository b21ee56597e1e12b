"""Self-join of bit strings within a Hamming distance, by walking a binary trie in pairs of nodes.

The trie is implicit: values are sorted, a node is a range that shares its leading
bits, its children are found by one search.  The walk holds pairs of nodes
with the number of bits in which their prefixes differ; a pair is dropped as soon as that number exceeds the
budget, so most of the square of all pairs is never looked at.  Pairs that are left with few values
are compared bit by bit at once.  Only connectedness is asked for: a pair of nodes
whose values are all linked already is dropped too, hence a dense
group costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SMALL = 64  # compare node pairs of so many value pairs at once
CHUNK = 1 << 14  # node pairs that are walked together
CHECKED = 1 << 10  # pairs that are checked together; the next ones profit from what these link


class Links:
    """Connected groups over positions 0..n-1."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.run_end = np.arange(1, n + 1)
        self.fresh = 0

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
            self.fresh += len(i)

    def refresh(self) -> None:
        """Where the run of equal labels ends that each position is in."""
        n = len(self.label)
        ends = np.flatnonzero(np.append(self.label[1:] != self.label[:-1], True)) + 1 if n else np.zeros(0, int)
        self.run_end = ends[np.searchsorted(ends, np.arange(n), "right")]
        self.fresh = 0

    def linked(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        return (self.label[lo1] == self.label[lo2]) & (self.run_end[lo1] >= hi1) & (self.run_end[lo2] >= hi2)


def link(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray, top: int, budget: int, check: Callable | None = None, over: int = -1, links: Links | None = None) -> Links:
    """Links, in each pair of ranges, what differs in more than `over` and at most `budget` bits and, where
    `check` is given, passes check(positions, positions).  values: unsigned 64-bit, ascending in each range; a range
    paired with itself is joined with itself; `top`: the highest bit that may differ within a range."""
    links = links or Links(len(values))
    small_int = np.int32 if len(values) < 2**31 else np.int64
    first = tuple(np.asarray(x, small_int) for x in (starts, ends, others, other_ends))
    # each entry: the bit to look at, four bounds and the bits spent so far; halves of a large one wait their turn
    stack = [(top, *first, np.zeros(len(starts), np.int8))]
    while stack:
        bit, *pairs = stack.pop()
        if len(pairs[0]) > CHUNK:
            stack += [(bit, *(x[CHUNK:] for x in pairs)), (bit, *(x[:CHUNK] for x in pairs))]
            continue
        if links.fresh > len(values) // 8 + 64:
            links.refresh()
        lo1, hi1, lo2, hi2, err = pairs
        keep = (err <= budget) & (hi1 > lo1) & (hi2 > lo2) & ~((lo1 == lo2) & (hi1 - lo1 < 2))
        lo1, hi1, lo2, hi2, err = (x[keep] for x in pairs)
        keep = ~links.linked(lo1, hi1, lo2, hi2)
        lo1, hi1, lo2, hi2, err = (x[keep] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        n1, n2 = (hi1 - lo1).astype(np.int64), (hi2 - lo2).astype(np.int64)
        small = (n1 * n2 <= SMALL) | (bit < 0)
        if small.any():
            _compare(values, links, lo1[small], n1[small], lo2[small], n2[small], budget, check, over)
        lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        m1, m2 = _split(values, lo1, hi1, bit), _split(values, lo2, hi2, bit)
        rest, more = lo1 != lo2, err + np.int8(1)
        # left with left, right with right; then across, which costs one bit
        new = [(lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, more)]
        new.append(tuple(x[rest] for x in (m1, hi1, lo2, m2, more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*new))))
    return links


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position in lo..hi whose `bit` is set; the bits above are the same in the whole range."""
    a, b, shift = lo.copy(), hi.copy(), np.uint64(bit)
    while (open_ := a < b).any():
        mid = (a + b) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a).astype(lo.dtype)
    return a


def _compare(values: np.ndarray, links: Links, lo1, n1, lo2, n2, budget: int, check: Callable | None, over: int) -> None:
    """Link by direct comparison, in pieces; a pair is a range of at most SMALL products or of equal values."""
    sizes = n1 * n2
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18))) + 1, len(sizes))
    a = 0
    for b in cuts:
        if b > a:
            which = np.repeat(np.arange(a, b), sizes[a:b])
            k = np.arange(len(which)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
            i, j = lo1[which] + k // n2[which], lo2[which] + k % n2[which]
            bits = np.bitwise_count(values[i] ^ values[j]).astype(np.int8)
            near = (bits <= budget) & (bits > over) & (i != j)
            i, j = i[near], j[near]
            if check is None:
                links.join(i, j)
            while check and len(i):
                apart = links.label[i] != links.label[j]
                i, j = i[apart], j[apart]
                some = check(i[:CHECKED], j[:CHECKED])
                links.join(i[:CHECKED][some], j[:CHECKED][some])
                i, j = i[CHECKED:], j[CHECKED:]
        a = b
