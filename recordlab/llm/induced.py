"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes as smaller or larger than their right neighbour, sorts the
leftmost-smaller substrings (recursively, when two of them are equal) and induces all other
suffixes from them in two linear passes. Over bytes both passes work on whole buckets of the
first character in numpy; the shorter strings of the recursion have large alphabets and small
buckets and are induced entry by entry.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as smaller."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    where = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def _append(sa: np.ndarray, free: np.ndarray, chars: np.ndarray, entries: np.ndarray, step: int) -> None:
    """Put entries at the free ends of their buckets, in order; ``step`` is 1 or -1."""
    order = np.argsort(chars, kind="stable")
    chars, entries = chars[order], entries[order]
    start = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    size = np.diff(np.append(start, len(chars)))
    rank = np.arange(len(chars)) - np.repeat(start, size)
    sa[free[chars] + step * rank] = entries
    free[chars[start]] += step * size


def _induce_buckets(t, small, bounds, lms) -> np.ndarray:
    """Both passes over whole buckets; ``lms`` in the order that is already known."""
    n = len(t)
    sa = np.full(n, -1, dtype=np.int32)
    heads, tails = bounds[:-1].copy(), bounds[1:] - 1
    used = np.flatnonzero(np.diff(bounds)).tolist()
    first = tails.copy()
    _append(sa, first, t[lms[::-1]], lms[::-1], -1)
    free = heads.copy()
    for c in used:
        done = int(heads[c])
        while done < free[c]:
            entries = sa[done : free[c]]
            done = int(free[c])
            before = entries[entries > 0] - 1
            before = before[~small[before]]
            if len(before):
                _append(sa, free, t[before], before, 1)
        entries = sa[first[c] + 1 : bounds[c + 1]]
        before = entries[entries > 0] - 1
        before = before[~small[before]]
        if len(before):
            _append(sa, free, t[before], before, 1)
    larger = free
    free = tails.copy()
    for c in reversed(used):
        done = int(tails[c])
        while done > free[c]:
            entries = sa[free[c] + 1 : done + 1][::-1]
            done = int(free[c])
            before = entries[entries > 0] - 1
            before = before[small[before]]
            if len(before):
                _append(sa, free, t[before], before, -1)
        entries = sa[heads[c] : larger[c]][::-1]
        before = entries[entries > 0] - 1
        before = before[small[before]]
        if len(before):
            _append(sa, free, t[before], before, -1)
    sa[0] = n - 1  # the end mark is the smallest suffix and follows nothing
    return sa


def _induce_entries(t, small, bounds, lms) -> np.ndarray:
    n = len(t)
    text, kind, ends = t.tolist(), small.tolist(), bounds.tolist()
    sa = [-1] * n
    tail = [e - 1 for e in ends[1:]]
    for p in reversed(lms.tolist()):
        c = text[p]
        sa[tail[c]] = p
        tail[c] -= 1
    head = ends[:-1]
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not kind[p]:
            c = text[p]
            sa[head[c]] = p
            head[c] += 1
    tail = [e - 1 for e in ends[1:]]
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and kind[p]:
            c = text[p]
            sa[tail[c]] = p
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa, dtype=np.int32)


def _names(t, lms, lms_sorted) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring in text order; equal ones share it."""
    n, m = len(t), len(lms)
    rank_of = np.empty(n, dtype=np.int32)
    rank_of[lms] = np.arange(m)
    at = rank_of[lms_sorted]
    end = np.append(lms[1:], n - 1)  # each substring ends at the next one's start
    size = (end - lms + 1)[at]
    same = size[1:] == size[:-1]
    left, right = lms_sorted[:-1], lms_sorted[1:]
    alive = np.flatnonzero(same)
    offset = 0
    while len(alive):
        alive = alive[offset < size[1:][alive]]
        if not len(alive):
            break
        equal = t[left[alive] + offset] == t[right[alive] + offset]
        same[alive[~equal]] = False
        alive = alive[equal]
        offset += 1
    new = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(m, dtype=np.int64)
    names[at] = new
    return names, int(new[-1]) + 1


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; the last must be a single smallest 0."""
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    t = np.ascontiguousarray(t, dtype=np.int32)
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t))])
    induce = _induce_buckets if len(bounds) < 1024 and n > 20_000 else _induce_entries
    sa = induce(t, small, bounds, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    names, distinct = _names(t, lms, sa[is_lms[sa]])
    if distinct < len(lms):
        order = suffix_array(names)
    else:
        order = np.empty(len(lms), dtype=np.int32)
        order[names] = np.arange(len(lms), dtype=np.int32)
    return induce(t, small, bounds, lms[order])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per position in text order: its predecessor in the suffix array (-1: none), and the length
    of their common prefix, counted up to ``most``."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int32)
    before[sa[1:]] = sa[:-1]
    length = np.zeros(n, dtype=np.int32)
    if t.max(initial=0) > 255:
        raise ValueError("symbols must fit into a byte")
    # eight symbols in one word; two suffixes differ at the latest where one meets the end mark
    words = np.concatenate([t, np.zeros(most + 16, dtype=t.dtype)]).astype(np.uint64)
    for step in (1, 2, 4):
        words = words[:-step] | (words[step:] << np.uint64(8 * step))
    alive = np.flatnonzero(before >= 0)
    other = before[alive]
    for offset in range(0, most, 8):
        apart = words[alive + offset] ^ words[other + offset]
        equal = apart == 0
        low = apart[~equal]
        length[alive[~equal]] = offset + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8
        alive, other = alive[equal], other[equal]
        if not len(alive):
            break
    length[alive] = most
    return before, np.minimum(length, most)
