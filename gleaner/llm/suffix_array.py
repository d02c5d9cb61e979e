"""Two-stage suffix sorting in numpy, and common prefixes of neighbours in the order.

A suffix is *ascending* if it is smaller than its successor (the suffix one place on), else *descending*; the last one is
descending. Stage one sorts the ascending suffixes directly, by their first bytes. Stage two scans the buckets of first bytes in order: each suffix read puts the one before it, if that
is descending, at the next free place of its bucket. All steps work on whole buckets at a time.

Where only some places are wanted, the others are left out but for those that the order of the wanted ones is induced from: a
descending suffix needs its successors up to the next ascending one.

The order is exact up to ``depth`` bytes; suffixes alike to that depth are in any order among themselves.
"""

from __future__ import annotations

import numpy as np

#: Suffixes whose bytes are laid out side by side at once while they are sorted.
_PAD, MOST = 16, 4_000_000


def _words(padded: np.ndarray, n: int, size: int) -> np.ndarray:
    """At each of the first n places, the size bytes from there as one number."""
    out = padded[:n].astype(np.uint64)
    for k in range(1, size):
        out <<= np.uint64(8)
        out |= padded[k : n + k]
    return out


def ascending(t: np.ndarray) -> np.ndarray:
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int16), append=np.int16(-1)))
    turn = np.where(step != 0, np.arange(n), n - 1)
    return step[np.minimum.accumulate(turn[::-1])[::-1]] > 0


def direct_sort(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at the given places, sorted by their first depth bytes; padded reaches so far beyond the last of them."""
    if len(at) > MOST:
        # in parts by first byte
        parts = [at[padded[at] == c] for c in np.unique(padded[at])]
        if len(parts) > 1:
            return np.concatenate([direct_sort(padded, p, depth) for p in parts])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[at]
    return at[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]


def _closed(wanted: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The wanted places and those that their order is induced from: on to the next ascending suffix, or the last one."""
    n = len(up)
    following = np.where(up, np.arange(n), n - 1)
    following = np.minimum.accumulate(following[::-1])[::-1]
    first = np.flatnonzero(wanted & ~np.append(False, wanted[:-1]))
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, following[last] + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_array(t: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All places of t (uint8), by the first depth bytes of their suffixes; or those wanted (a flag a place), and some more that they need."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([t, np.zeros(depth + _PAD, np.uint8)])
    up = ascending(t)
    held = np.ones(n, bool) if wanted is None else _closed(wanted, up)
    if not held.any():
        return np.zeros(0, np.int64)
    sizes = np.bincount(t[held], minlength=256)
    start = np.concatenate([[0], np.cumsum(sizes)])
    down = np.bincount(t[held & ~up], minlength=256)
    direct = direct_sort(padded, np.flatnonzero(held & up), depth)
    out = np.empty(start[-1], np.int64)
    # the directly sorted ones fill the ends of their buckets
    firsts = t[direct]
    base = start[:256] + down
    within = np.arange(len(direct)) - np.concatenate([[0], np.cumsum(sizes - down)])[firsts]
    out[base[firsts] + within] = direct
    free = start[:256].copy()
    if held[n - 1]:
        out[free[t[n - 1]]] = n - 1
        free[t[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        front = out[start[c] : free[c]]
        while len(front):
            before = front[front > 0] - 1
            front = before[(t[before] == c) & held[before]]
            out[free[c] : free[c] + len(front)] = front
            free[c] += len(front)
        bucket = out[start[c] : start[c + 1]]
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & held[before]]
        if len(before):
            before = before[np.argsort(t[before], kind="stable")]
            chars = t[before]
            many = np.bincount(chars, minlength=256)
            rank = np.arange(len(before)) - (np.cumsum(many) - many)[chars]
            out[free[chars] + rank] = before
            free += many
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place in order but the first: the length of its common prefix with the one before it, at most cap; 0 first."""
    size = 8
    words = _words(np.concatenate([t, np.zeros(cap + _PAD, np.uint8)]), len(t) + cap, size)
    out = np.full(len(order), cap, np.int64)
    out[:1] = 0
    a, b = order[:-1], order[1:]
    live = np.arange(1, len(order))
    for deep in range(0, cap, size):
        differ = words[b + deep] ^ words[a + deep]
        ended = np.flatnonzero(differ)
        x = differ[ended]
        alike = np.full(len(ended), size)
        for k in range(size):
            alike[x >= np.uint64(1) << np.uint64(8 * k)] = size - 1 - k
        out[live[ended]] = deep + alike
        on = np.flatnonzero(differ == 0)
        live, a, b = live[on], a[on], b[on]
        if not len(live):
            break
    room = len(t) - order
    out[1:] = np.minimum(np.minimum(out[1:], np.minimum(room[1:], room[:-1])), cap)
    return out
