"""Suffix arrays by induced sorting (SA-IS) and permuted longest common prefixes, vectorised in numpy.

Induced sorting scans the array once in each direction. A scan's entries up to the first place that is still to be
filled are all final, so they are taken as one batch: numpy places their predecessors at their buckets' ends, in
order. On n symbols a scan makes about sqrt(n) batches.
"""

from __future__ import annotations

import numpy as np


def _place(bucket_next: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Places for entries of these buckets, in order; advances the buckets' ends by ``step`` each."""
    if not len(kinds):
        return kinds
    order = np.argsort(kinds, kind="stable")
    sorted_ = kinds[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    times = np.diff(np.append(first, len(sorted_)))
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds)) - np.repeat(first, times)
    at = bucket_next[kinds] + step * rank
    bucket_next[sorted_[first]] += step * times
    return at


def _induce(s: np.ndarray, typ: np.ndarray, lms: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in (the wanted) order: L-types left to right, S-types right to left."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    nxt = tail.copy()
    sa[_place(nxt, s[lms[::-1]], -1)] = lms[::-1]
    n_l = np.bincount(s[~typ], minlength=len(head))
    # left to right: a place of a bucket's L part that is still empty ends the batch
    wanted = np.zeros(n + 1, np.int64)
    np.add.at(wanted, head[n_l > 0], 1)
    np.add.at(wanted, (head + n_l)[n_l > 0], -1)
    l_part = np.cumsum(wanted[:n]) > 0
    nxt, p = head.copy(), 0
    # the last suffix (an L-type, before the sentinel that is smaller than all) comes first
    sa[nxt[s[n - 1]]] = n - 1
    nxt[s[n - 1]] += 1
    size = 256
    while p < n:
        look = sa[p:p + size]
        hole = np.flatnonzero((look < 0) & l_part[p:p + size])
        q = p + (int(hole[0]) if len(hole) else len(look))
        size = min(max(256, 2 * (q - p)), 1 << 16)
        got = sa[p:q]
        got = got[got > 0] - 1
        got = got[~typ[got]]
        if len(got):
            sa[_place(nxt, s[got], 1)] = got
        p = q
    # right to left: the S parts are filled anew
    sa[~l_part] = -1
    nxt, p, size = tail.copy(), n, 256
    while p > 0:
        a = max(0, p - size)
        hole = np.flatnonzero((sa[a:p] < 0))
        q = a + (int(hole[-1]) + 1 if len(hole) else 0)
        size = min(max(256, 2 * (p - q)), 1 << 16)
        got = sa[q:p][::-1]
        got = got[got > 0] - 1
        got = got[typ[got]]
        if len(got):
            sa[_place(nxt, s[got], -1)] = got
        p = q
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative integers by SA-IS (a shorter suffix comes before its extensions)."""
    s = np.ascontiguousarray(s, np.int64)
    n = len(s)
    if n < 2:
        return np.arange(n)
    k = int(s.max()) + 1
    if k > 2 * n:  # keep the buckets in proportion
        s = np.unique(s, return_inverse=True)[1].astype(np.int64)
        k = int(s.max()) + 1
    # classify: S if smaller than the next suffix; equal symbols follow their successor; the last is L
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(s[1:] - s[:-1])
    less[-1] = -1
    at = np.where(less != 0, np.arange(n), n)
    after = np.minimum.accumulate(at[::-1])[::-1]
    typ = less[after] > 0
    lms = np.flatnonzero(typ & ~np.concatenate([[True], typ[:-1]]))
    count = np.bincount(s, minlength=k)
    tail = np.cumsum(count) - 1
    head = tail - count + 1
    if len(lms) > 1:
        # sort the LMS substrings by inducing from them in any order, then name them
        sa = _induce(s, typ, lms, head, tail)
        rank = np.full(n, -1, np.int64)
        rank[lms] = np.arange(len(lms))
        order = rank[sa]
        order = order[order >= 0]
        end = np.append(lms[1:], n - 1)  # an LMS substring reaches to the next LMS symbol
        a, b = order[:-1], order[1:]
        length = end - lms
        differ = (length[a] != length[b]) | (a == len(lms) - 1) | (b == len(lms) - 1)
        rest, off = np.flatnonzero(~differ), 0
        while len(rest):
            i, j = lms[a[rest]] + off, lms[b[rest]] + off
            bad = (s[i] != s[j]) | (typ[i] != typ[j])
            differ[rest[bad]] = True
            rest = rest[~bad]
            off += 1
            rest = rest[length[a[rest]] >= off]
        name = np.empty(len(lms), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(differ)])
        lms = lms[np.argsort(name) if int(name.max()) + 1 == len(lms) else suffix_array(name)]
    return _induce(s, typ, lms, head, tail)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """The longest common prefix of each suffix array entry with the one before, up to ``most``.

    They are computed in text order (the permuted form), where neighbours read neighbouring memory, for all suffixes
    at once: each is compared with its predecessor in the array four symbols at a time, then one at a time, and
    leaves at the first difference. Symbols are below 2**16 - 1.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    # four symbols of 16 bits make a word
    ext = np.concatenate([s.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    four = ext[:-3] | ext[1:-2] << np.uint64(16) | ext[2:-1] << np.uint64(32) | ext[3:] << np.uint64(48)
    size = np.zeros(n, np.int64)
    here = np.flatnonzero(before >= 0)
    wide = True
    while len(here):
        i, j = here + size[here], before[here] + size[here]
        if wide:
            same = four[np.minimum(i, n)] == four[np.minimum(j, n)]
            same &= (np.maximum(i, j) + 4 <= n) & (size[here] + 4 <= most)
            here = here[same]
            size[here] += 4
            if not len(here):  # then the last symbols one at a time
                wide, here = False, np.flatnonzero(before >= 0)
            continue
        same = (np.maximum(i, j) < n) & (size[here] < most)
        same &= ext[np.minimum(i, n)] == ext[np.minimum(j, n)]
        here = here[same]
        size[here] += 1
    return size[sa]
