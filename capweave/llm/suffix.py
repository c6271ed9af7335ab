"""Induced sorting: suffix arrays of many short segments, and their permuted common prefixes, in numpy.

The text is the segments, each ended by a separator below every byte. Suffixes are classified as smaller or larger
than their right neighbour; the leftmost-smaller (LMS) substrings are sorted by a first induction, named, and ordered
by the names of themselves and what follows, recursively over doubled lengths up to the segment's end; a second
induction gives the suffix array. Both inductions are linear: a bucket (first byte) is taken as a whole, in rounds
where suffixes of the same bucket induce each other. Suffixes that are equal up to their separators keep the order
of their segments.
"""

from __future__ import annotations

import numpy as np

SYMBOLS, NOTHING = 257, 0xFFFF


class Text:
    """Segments as one symbol array with its suffix types."""

    def __init__(self, segments: list[bytes] | tuple[np.ndarray, np.ndarray]) -> None:
        """segments: byte strings, or (all their bytes in a row, their lengths)."""
        if not isinstance(segments, tuple):
            segments = np.frombuffer(b"".join(segments), np.uint8), np.fromiter(map(len, segments), np.int64, len(segments))
        flat, lengths = segments
        self.ends = np.cumsum(lengths + 1) - 1  # of each segment: where its separator stands
        self.starts = self.ends - lengths
        n = len(flat) + len(lengths)
        self.t = np.zeros(n, np.uint16)
        body = np.ones(n, bool)
        body[self.ends] = False
        self.t[body] = flat.astype(np.uint16) + 1
        # the end of the segment that each position is in
        self.end_of = np.repeat(self.ends, lengths + 1)
        # smaller than the right neighbour: equal ones do as the next different pair does
        self.small = np.ones(n, bool)
        if n > 1:
            differ = np.where(self.t[:-1] != self.t[1:], np.arange(n - 1), n - 1)
            at = np.minimum.accumulate(differ[::-1])[::-1]
            inner = at < n - 1
            self.small[:-1][inner] = self.t[at[inner]] < self.t[at[inner] + 1]
        self.lms = np.zeros(n, bool)
        self.lms[1:] = self.small[1:] & ~self.small[:-1]
        self.sizes = np.bincount(self.t, minlength=SYMBOLS)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        # what stands before each position, if it is larger / smaller than its right neighbour
        left = np.concatenate([[NOTHING], self.t[:-1]]).astype(np.uint16)
        left_small = np.concatenate([[False], self.small[:-1]])
        self.larger_before = np.where(left_small, np.uint16(NOTHING), left)
        self.smaller_before = np.where(left_small, left, np.uint16(NOTHING))


def induce(x: Text, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that LMS positions in a given order induce."""
    t, n = x.t, len(x.t)
    sa = np.full(n, -1, np.int64)
    head = x.begin[:-1].copy()
    by = t[seeds]
    order = np.argsort(by, kind="stable")
    seeds, bounds = seeds[order], np.searchsorted(by[order], np.arange(SYMBOLS + 1))

    def larger(batch: np.ndarray) -> None:
        c = x.larger_before[batch]
        on = c != NOTHING
        j, c = batch[on] - 1, c[on]
        if len(j):
            o = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=SYMBOLS)
            c, j = c[o], j[o]
            sa[(head - (np.cumsum(counts) - counts))[c] + np.arange(len(j))] = j
            head[:] += counts

    for c in range(SYMBOLS):
        at = x.begin[c]
        while at < head[c]:
            batch, at = sa[at : head[c]], head[c]
            larger(batch)
        if bounds[c] < bounds[c + 1]:
            larger(seeds[bounds[c] : bounds[c + 1]])
    tail = x.begin[1:].copy()

    def smaller(batch: np.ndarray) -> None:
        c = x.smaller_before[batch]
        on = c != NOTHING
        j, c = batch[on] - 1, c[on]
        if len(j):
            o = np.argsort(c, kind="stable")
            counts = np.bincount(c, minlength=SYMBOLS)
            c, j = c[o], j[o]
            sa[(tail + (np.cumsum(counts) - counts))[c] - 1 - np.arange(len(j))] = j
            tail[:] -= counts

    for c in range(SYMBOLS - 1, -1, -1):
        at = x.begin[c + 1]
        while at > tail[c]:
            batch, at = sa[tail[c] : at][::-1], tail[c]
            smaller(batch)
        if x.begin[c] < head[c]:
            smaller(sa[x.begin[c] : head[c]][::-1])
    sa[0] = n - 1  # the last separator; nothing stands after it to induce it
    return sa


def ordered_lms(x: Text) -> np.ndarray:
    """LMS positions in the order of their suffixes."""
    at = np.flatnonzero(x.lms)
    sa = induce(x, at)
    ranked = sa[x.lms[sa]]
    # name: equal substrings, from one LMS position to the next, get equal names; a separator ends its segment
    nxt = np.append(at[1:], len(x.t) - 1)
    index = np.full(len(x.t), -1, np.int64)
    index[at] = np.arange(len(at))
    k = index[ranked]
    a, b = ranked[:-1], ranked[1:]
    span_a, span_b = (nxt - at)[k[:-1]], (nxt - at)[k[1:]]
    ends = (x.t[a] == 0) & (x.t[b] == 0)
    same = (span_a == span_b) & (x.t[a] == x.t[b])
    live = np.flatnonzero(same & ~ends)
    step = 1
    while len(live):
        live = live[step <= span_a[live]]
        ok = x.t[a[live] + step] == x.t[b[live] + step]
        same[live[~ok]] = False
        live, step = live[ok], step + 1
    # a name is the first place of its group in the order; k holds the LMS positions in that order
    n = len(at)
    head = np.concatenate([[True], ~(same | ends)])
    names = np.empty(n, np.int64)
    names[k] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # what follows, recursively: of groups not yet told apart, pairs of names, doubling, not past the segment's separator
    last = index[x.end_of[at]]
    reach, order = 1, k.copy()
    longest = int((last - np.arange(n)).max(initial=0))
    while True:
        open_ = ~head | ~np.append(head[1:], True)
        slots = np.flatnonzero(open_)
        some = np.sort(order[slots])  # equal ones stay in the order of their segments
        pair = names[some] * (n + 1) + names[np.minimum(some + reach, last[some])]
        by = np.argsort(pair, kind="stable")
        some, pair = some[by], pair[by]
        order[slots] = some
        if reach > longest or not len(slots):
            return at[order]
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        head[slots] = first
        names[some] = np.maximum.accumulate(np.where(first, slots, 0))
        reach *= 2


def suffix_array(x: Text) -> np.ndarray:
    return induce(x, ordered_lms(x))


def common_prefixes(x: Text, sa: np.ndarray, least: int = 1) -> np.ndarray:
    """Permuted common prefixes: for each position, bytes in common with the suffix before it in the array, not past a separator.

    Suffixes of fewer than `least` bytes can't have so many in common: they are left out (0).
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    had = np.zeros(len(x.starts), np.int64)
    for off in range(int((x.ends - x.starts).max(initial=0)) - least + 1):
        seg = np.flatnonzero(x.starts + off + least <= x.ends)
        i = x.starts[seg] + off
        p = before[i]
        most = np.where(p >= 0, np.minimum(x.ends[seg] - i, x.end_of[p] - p), 0)
        length = np.minimum(np.maximum(had[seg] - 1, 0), most)
        live = np.flatnonzero(length < most)
        while len(live):
            ok = x.t[i[live] + length[live]] == x.t[p[live] + length[live]]
            live = live[ok]
            length[live] += 1
            live = live[length[live] < most[live]]
        out[i] = had[seg] = length
    return out


def repeated_classes(x: Text, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, class numbers) of the suffixes that share their first `length` bytes with another suffix."""
    sa = suffix_array(x)
    lcp = common_prefixes(x, sa, length)[sa]
    joined = lcp >= length
    member = joined | np.append(joined[1:], False)
    number = np.cumsum(~joined)
    return sa[member], number[member]
