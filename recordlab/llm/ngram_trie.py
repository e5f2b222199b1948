"""An n-gram trie of one shard: Elias-Fano pointers, quantised probabilities, memory-mapped levels.

The levels are words (sorted 64-bit hashes), successors of a word, predecessors of a word, and
successors of a pair. Pointers from a level to the next are monotone and kept by Elias and Fano's
code. A successor of a pair is written as its rank among the successors of the pair's last word,
so its numbers are small; a lookup first finds that rank and then searches the pair's own range.
"""

from __future__ import annotations

import os

import numpy as np

#: probabilities are kept as negated binary logarithms in steps of 2**-10, 65535 is zero
STEP, ZERO = 1024, 65_535
#: added pseudo-counts of the shorter context, after a word and after a pair
PRIOR_2, PRIOR_3 = 8.0, 2.0
_ONE = np.uint64(1)


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log2(p) * STEP)
    return np.where(p > 0, np.clip(code, 0, ZERO - 1), ZERO).astype(np.uint16)


def probabilities(code: np.ndarray) -> np.ndarray:
    return np.where(code == ZERO, 0.0, np.exp2(code.astype(np.float64) / -STEP))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code of the product of two probabilities."""
    both = np.minimum(a.astype(np.uint32) + b, ZERO - 1)
    return np.where((a == ZERO) | (b == ZERO), ZERO, both).astype(np.uint16)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, one after the other in 64-bit words (and a spare word)."""
    groups = -(-len(values) // 64)
    padded = np.zeros(groups * 64, dtype=np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(groups, 64)
    out = np.zeros((groups, bits), dtype=np.uint64)
    for j in range(64 if bits else 0):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return np.append(out.ravel(), np.uint64(0))


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), dtype=np.int64)
    place = at * bits
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
    return ((low | high) & np.uint64((1 << bits) - 1)).astype(np.int64)


def width(most: int) -> int:
    return int(most).bit_length()


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """Parts of the code of a non-decreasing sequence: low bits, unary high bits, ones before
    every eighth word of them."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    place = (values >> low) + np.arange(n)
    high = np.zeros((n + (top >> low)) // 512 * 8 + 8, dtype=np.uint64)
    np.bitwise_or.at(high, place >> 6, _ONE << (place & 63).astype(np.uint64))
    ones = np.bitwise_count(high).reshape(-1, 8).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)
    return {"low": pack(values & ((1 << low) - 1), low), "high": high, "before": before, "bits": np.array([low])}


def _select(high: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k-th ones."""
    block = np.searchsorted(before, k, side="right") - 1
    left, word = k - before[block], block * 8
    for _ in range(7):
        n = np.bitwise_count(high[word]).astype(np.int64)
        further = left >= n
        left = left - n * further
        word = word + further
    bits, at = high[word], np.zeros(len(k), dtype=np.int64)
    for size in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(bits & np.uint64((1 << size) - 1)).astype(np.int64)
        further = left >= n
        left = left - n * further
        bits = np.where(further, bits >> np.uint64(size), bits)
        at += size * further
    return word * 64 + at


def _starts(first: np.ndarray, n: int) -> np.ndarray:
    """Range starts of ``n`` groups in rows sorted by group, with the end as the last one."""
    return np.concatenate([[0], np.cumsum(np.bincount(first, minlength=n))]).astype(np.int64)


def distinct(keys: list[np.ndarray], weight: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of integer columns below ``size``, and the sum of their weights."""
    if size ** len(keys) < 1 << 62:
        key = keys[0]
        for k in keys[1:]:
            key = key * size + k
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
    else:
        order = np.lexsort(keys[::-1])
        new = np.logical_or.reduce([np.diff(k[order], prepend=-1) != 0 for k in keys])
    at = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], at) if len(at) else weight[:0]
    return [k[order[at]] for k in keys], total


def levels_of(words, u, v, w, count, total_v=None, total_uv=None, open_v=None) -> dict[str, np.ndarray]:
    """All levels from trained trigrams ``(u, v, w)`` as places in the sorted ``words``; without
    ``u``, from pairs.

    ``total_v`` and ``total_uv`` give counts of contexts that are spread over shards (0: none).
    ``open_v`` marks words whose successors are counted elsewhere: their probabilities leave the
    shorter context out.
    """
    size = len(words)
    open_v = np.zeros(size, dtype=bool) if open_v is None else open_v
    (v2, w2), c2 = distinct([v, w], count, size)
    sum2 = np.bincount(v2, weights=c2, minlength=size)
    sum2 = np.where(total_v > 0, total_v, sum2) if total_v is not None else sum2
    a2 = np.where(open_v[v2], 0.0, c2 / (sum2[v2] + PRIOR_2))
    b2 = np.where(open_v, 1.0, PRIOR_2 / (sum2 + PRIOR_2))
    p2 = _starts(v2, size)
    if u is None:
        u = v = w = count = v[:0]
    (v3, u3, w3), c3 = distinct([v, u, w], count, size)
    new = np.ones(len(v3), dtype=bool)
    new[1:] = (v3[1:] != v3[:-1]) | (u3[1:] != u3[:-1])
    pair = np.cumsum(new) - 1
    vp, up = v3[new], u3[new]
    sum3 = np.bincount(pair, weights=c3, minlength=len(vp))
    if total_uv is not None:
        sum3 = np.where((known := total_uv(vp, up)) > 0, known, sum3)
    # rank of w among the successors of v: both lists are sorted by (v, w)
    rank = np.searchsorted(v2 * size + w2, v3 * size + w3) - p2[v3]
    at2 = p2[v3] + rank
    a3 = (c3 + PRIOR_3 * a2[at2]) / (sum3[pair] + PRIOR_3)
    bits, rank_bits = width(max(size - 1, 0)), width(rank.max(initial=0))
    out = {
        "words": words,
        "bits": np.array([bits, rank_bits]),
        "successors": pack(w2, bits),
        "after_word": quantised(a2),
        "left_word": quantised(b2),
        "predecessors": pack(up, bits),
        "left_pair": quantised(PRIOR_3 / (sum3 + PRIOR_3)),
        "ranks": pack(rank, rank_bits),
        "after_pair": quantised(a3),
    }
    pointers = {"to_successors": p2, "to_predecessors": _starts(vp, size), "to_ranks": _starts(pair, len(vp))}
    for name, values in pointers.items():
        out |= {f"{name}.{part}": x for part, x in elias_fano(values).items()}
    return out


def save(levels: dict[str, np.ndarray], folder: str) -> None:
    for name, x in levels.items():
        np.save(os.path.join(folder, f"{name}.npy"), x)


class Trie:
    """Read side over memory-mapped levels in ``folder``."""

    def __init__(self, folder: str):
        self._levels = {}
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            # an empty level is all header and can't be mapped
            self._levels[name[:-4]] = np.load(path, mmap_mode="r" if os.path.getsize(path) > 128 else None)
        self.words = self._levels["words"]
        self.bits, self.rank_bits = (int(x) for x in self._levels["bits"])

    def _pointer(self, name: str, at: np.ndarray) -> np.ndarray:
        high, before, low = (self._levels[f"{name}.{p}"] for p in ("high", "before", "low"))
        bits = int(self._levels[f"{name}.bits"][0])
        return (_select(high, before, at) - at) << bits | unpack(low, bits, at)

    def _search(self, level: str, bits: int, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of ``key`` in the sorted range ``low..high`` of a level, or -1."""
        packed, end, low, high = self._levels[level], high, low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = unpack(packed, bits, middle) < key[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        inside = np.flatnonzero(low < end)
        hit = inside[unpack(packed, bits, low[inside]) == key[inside]]
        found = np.full(len(key), -1, dtype=np.int64)
        found[hit] = low[hit]
        return found

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for one that the shard doesn't know."""
        if not len(self.words):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def lookup(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes ``a, b`` of ``p(w | u v) = a + b * p(w)`` by places of words; -1 in ``u`` asks
        for ``p(w | v)``."""
        a = np.full(len(w), ZERO, dtype=np.uint16)
        b = np.zeros(len(w), dtype=np.uint16)
        q = np.flatnonzero(v >= 0)
        if not len(q):
            return a, b
        u, v, w = u[q], v[q], w[q]
        start = self._pointer("to_successors", v)
        two = self._search("successors", self.bits, start, self._pointer("to_successors", v + 1), w)
        own = np.full(len(q), ZERO, dtype=np.uint16)
        own[two >= 0] = self._levels["after_word"][two[two >= 0]]
        rest = self._levels["left_word"][v]
        pair = self._search(
            "predecessors", self.bits, self._pointer("to_predecessors", v), self._pointer("to_predecessors", v + 1), u
        )
        p = np.flatnonzero(pair >= 0)
        left = self._levels["left_pair"][pair[p]]
        own[p], rest[p] = times(own[p], left), times(rest[p], left)
        p = p[two[p] >= 0]
        three = self._search(
            "ranks", self.rank_bits, self._pointer("to_ranks", pair[p]), self._pointer("to_ranks", pair[p] + 1), two[p] - start[p]
        )
        own[p[three >= 0]] = self._levels["after_pair"][three[three >= 0]]
        a[q], b[q] = own, rest
        return a, b
