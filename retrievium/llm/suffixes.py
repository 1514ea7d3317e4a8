"""Suffix arrays with common-prefix values by external induced sorting.

Queues are disk-backed: a bucket of known size for each symbol, first in first out. As a scan meets suffixes in their order, the
order in which a queue is filled is the order of its suffixes, so it is a priority queue with keys (symbol, rank). What goes
through it is a tuple (position, common prefix with the tuple before it). An alphabet of more than BASE values, that of
the names in a recursion included, is written as two digits, so that queues are few (the square root of the alphabet) and
each pass over one is a handful of vector operations over up to CHUNK tuples.

Arrays beyond `memory` bytes are memory-mapped files in `folder`, if one is given.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

BASE, CHUNK, SMALL = 1 << 12, 1 << 18, 1 << 15


class Space:
    """Where arrays are: in memory, or from `memory` bytes on in files of a folder."""

    def __init__(self, folder: str | None = None, memory: int = 1 << 26) -> None:
        self.folder, self.memory = folder, memory

    def array(self, n: int, kind: type) -> np.ndarray:
        if self.folder is None or n * np.dtype(kind).itemsize <= self.memory:
            return np.zeros(n, kind)
        at = os.path.join(self.folder, uuid.uuid4().hex)
        out = np.memmap(at, kind, "w+", shape=(n,))
        os.unlink(at)  # the file lives as long as the map, also if the task is killed
        return out


class DiskQueue:
    """A monotone priority queue over (symbol, rank): one region of the arrays for each symbol."""

    def __init__(self, sizes: np.ndarray, space: Space) -> None:
        ends = np.cumsum(sizes)
        self.head, self.tail = ends - sizes, ends - sizes
        self.pos, self.lcp = space.array(int(sizes.sum()), np.int64), space.array(int(sizes.sum()), np.int32)
        self.since = np.full(len(sizes), -1, np.int64)  # least common prefix since the last push to each symbol

    def push(self, key: np.ndarray, pos: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """Push pos[j] under key[j]; at[j] is its source in the batch just scanned, lcp the batch's common prefixes."""
        m = len(lcp)
        if not m:
            return
        whole = int(lcp.min())
        if len(key):
            order = np.argsort(key, kind="stable")
            k, a = key[order], at[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(new)
            prev = np.empty(len(k), np.int64)
            prev[1:] = a[:-1]
            prev[first] = -1
            low = _range_min(lcp, prev + 1, a)
            low[first] = np.minimum(low[first], self.since[k[first]])
            count = np.diff(np.append(first, len(k)))
            slot = self.tail[k] + np.arange(len(k)) - np.repeat(first, count)
            self.pos[slot], self.lcp[slot] = pos[order], low + 1
            self.tail[k[first]] += count
            last = a[first + count - 1]
            rest = np.full(len(first), np.iinfo(np.int32).max, np.int64)
            some = last + 1 < m
            rest[some] = _range_min(lcp, last[some] + 1, np.full(int(some.sum()), m - 1))
            np.minimum(self.since, whole, out=self.since)
            self.since[k[first]] = rest
        else:
            np.minimum(self.since, whole, out=self.since)

    def pop(self, symbol: int, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        a = int(self.head[symbol])
        b = min(int(self.tail[symbol]), a + most)
        self.head[symbol] = b
        return np.array(self.pos[a:b]), np.array(self.lcp[a:b], np.int64)


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo..hi], ends included, for each pair."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    table = x
    for j in range(int(level.max(initial=0)) + 1):
        if j:
            half = 1 << (j - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        own = np.flatnonzero(level == j)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << j) + 1])
    return out


def _digits(x: np.ndarray, top: int) -> tuple[np.ndarray, int, int]:
    """x, values below top, as digits, most significant first; digits a value; their base."""
    width = max(1, int(top - 1).bit_length())
    m = 1 if top <= BASE else 2
    bits = -(-width // m)
    out = np.empty((len(x), m), np.int32)
    for j in range(m):
        out[:, j] = (x >> (bits * (m - 1 - j))) & ((1 << bits) - 1)
    return out.ravel(), m, 1 << bits


def _small(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix doubling, for a text that fits in the cache."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: max(0, n - step)] = rank[step:]
        sa = np.lexsort((nxt, rank))
        new = np.ones(n, np.int64)
        new[1:] = (rank[sa][1:] != rank[sa][:-1]) | (nxt[sa][1:] != nxt[sa][:-1])
        rank[sa] = np.cumsum(new) - 1
        if n == 0 or new.all():
            break
        step *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        lcp[1:] = _extend(t, sa[1:], sa[:-1], np.zeros(n - 1, np.int64))
    return sa, lcp


def _extend(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefix of suffixes a and b, of which `known` symbols are known to be equal."""
    out, todo = known.copy(), np.arange(len(a))
    while len(todo):
        i, j = a[todo] + out[todo], b[todo] + out[todo]
        inside = np.maximum(i, j) < len(t)
        todo, i, j = todo[inside], i[inside], j[inside]
        todo = todo[t[i] == t[j]]
        out[todo] += 1
    return out


def _sorted_substrings(t: np.ndarray, star: np.ndarray, base: int) -> np.ndarray:
    """Rank of each substring from a star position to the next, both included; equal ones get equal ranks."""
    n = len(star)
    size = np.append(np.diff(star) + 1, len(t) - star[-1] + 1)  # the last one ends in the end of text
    rank, active, at = np.zeros(n, np.int64), np.arange(n), 0
    width = base.bit_length() + 1
    per = max(1, 60 // width)
    while len(active):
        key = np.zeros(len(active), np.int64)
        for j in range(at, at + per):
            i = star[active] + j
            own = np.full(len(active), (1 << width) - 1, np.int64)  # what ended is greater: an S suffix comes after an L one
            there = (j < size[active]) & (i < len(t))
            own[there] = t[i[there]] + 1
            own[(j < size[active]) & (i == len(t))] = 0
            key = key << width | own
        order = np.lexsort((key, rank[active]))
        r, k = rank[active][order], key[order]
        group = np.ones(len(r), bool)
        group[1:] = r[1:] != r[:-1]
        part = group.copy()
        part[1:] |= k[1:] != k[:-1]
        idx = np.arange(len(r))
        within = np.maximum.accumulate(np.where(part, idx, 0)) - np.maximum.accumulate(np.where(group, idx, 0))
        rank[active[order]] = r + within
        at += per
        label = np.cumsum(part) - 1
        longer = np.bincount(label, weights=size[active[order]] > at) > 0
        many = np.bincount(label) > 1
        active = active[order][(longer & many)[label]]
    return rank


def suffix_array(text: np.ndarray, top: int, space: Space | None = None, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text (integers from 0 below top) and the common prefix of each suffix with the one before it."""
    space = space or Space()
    t, m, base = _digits(text, top)
    sa, lcp = _induce(t, base, space, small)
    if m == 1:
        return sa, lcp
    return _thin(sa, lcp, m)


def _thin(sa: np.ndarray, lcp: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """From digits back to values."""
    own = np.flatnonzero(sa % m == 0)
    if not len(own):
        return sa[:0], lcp[:0]
    low = np.minimum.reduceat(lcp[: own[-1] + 1], np.append(0, own[:-1] + 1)) if len(own) > 1 else np.zeros(1, np.int64)
    low[0] = 0
    return sa[own] // m, low // m


def _induce(t: np.ndarray, base: int, space: Space, small: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(t)
    if n <= max(small, 2):
        return _small(t)
    step = np.sign(np.diff(t.astype(np.int64), append=-1))  # 1: the next symbol is greater
    idx = np.arange(n)
    ahead = np.minimum.accumulate(np.where(step != 0, idx, n)[::-1])[::-1]
    is_s = step[ahead] > 0
    run = ahead - idx + 1
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    is_l_count = np.bincount(t[~is_s], minlength=base)
    is_s_count = np.bincount(t[is_s], minlength=base)

    if len(star):
        rank = _sorted_substrings(t, star, base)
        names = np.unique(rank, return_inverse=True)[1]
        if int(names.max()) + 1 == len(star):
            order = np.argsort(names, kind="stable")
            same = np.zeros(len(star), np.int64)
        else:
            order, same = suffix_array(names, int(names.max()) + 1, space, small)
        stars = star[order]
        star_lcp = np.zeros(len(star), np.int64)
        if len(star) > 1:
            whole = star[np.minimum(order[1:] + same[1:], len(star) - 1)] - star[order[1:]]
            star_lcp[1:] = _extend(t, stars[1:], stars[:-1], whole)
    else:
        stars, star_lcp = star, np.zeros(0, np.int64)
    star_at = np.searchsorted(t[stars], np.arange(base + 1))

    # left to right: L suffixes, from stars and from each other
    queue = DiskQueue(is_l_count, space)
    queue.pos[queue.tail[t[-1]]], queue.lcp[queue.tail[t[-1]]] = n - 1, 0
    queue.tail[t[-1]] += 1
    queue.since[t[-1]] = 0
    l_pos, l_lcp = space.array(int(is_l_count.sum()), np.int64), space.array(int(is_l_count.sum()), np.int32)
    l_at = np.append(0, np.cumsum(is_l_count))
    for c in range(base):
        at = int(l_at[c])
        while queue.head[c] < queue.tail[c]:
            pos, lcp = queue.pop(c)
            if at == l_at[c]:
                lcp[0] = 0
            l_pos[at : at + len(pos)], l_lcp[at : at + len(pos)] = pos, lcp
            at += len(pos)
            before = np.where(pos > 0, t[pos - 1], -1)
            j = np.flatnonzero(before >= c)
            queue.push(before[j], pos[j] - 1, j, lcp)
        for a in range(int(star_at[c]), int(star_at[c + 1]), CHUNK):
            b = min(a + CHUNK, int(star_at[c + 1]))
            pos, lcp = stars[a:b], star_lcp[a:b].copy()
            if a == star_at[c]:
                lcp[0] = min(run[l_pos[at - 1]], run[pos[0]]) if at > l_at[c] else 0
            queue.push(t[pos - 1], pos - 1, np.arange(len(pos)), lcp)

    # right to left: S suffixes, from L suffixes and from each other
    queue = DiskQueue(is_s_count, space)
    sa, out = space.array(n, np.int64), space.array(n, np.int32)
    ends = np.cumsum(is_l_count + is_s_count)
    for c in range(base - 1, -1, -1):
        at = end = int(ends[c])
        while queue.head[c] < queue.tail[c]:
            pos, lcp = queue.pop(c)
            if at == end:
                lcp[0] = 0
            else:
                out[at] = lcp[0]
            m = len(pos)
            sa[at - m : at] = pos[::-1]
            out[at - m + 1 : at] = lcp[1:][::-1]
            at -= m
            before = np.where(pos > 0, t[pos - 1], base)
            j = np.flatnonzero(before <= c)
            queue.push(before[j], pos[j] - 1, j, lcp)
        lo, hi = int(l_at[c]), int(l_at[c + 1])
        sa[at - (hi - lo) : at], out[at - (hi - lo) : at] = l_pos[lo:hi], l_lcp[lo:hi]
        cross = 0
        if at < end and hi > lo:
            cross = out[at] = min(run[l_pos[hi - 1]], run[sa[at]])
        elif at < end:
            out[at] = 0
        for b in range(hi, lo, -CHUNK):
            a = max(lo, b - CHUNK)
            pos = l_pos[a:b][::-1]
            lcp = np.empty(b - a, np.int64)
            lcp[1:] = l_lcp[a + 1 : b][::-1]
            lcp[0] = l_lcp[b] if b < hi else cross
            before = np.where(pos > 0, t[pos - 1], base)
            j = np.flatnonzero(before < c)
            queue.push(before[j], pos[j] - 1, j, lcp)
    return sa, out
