"""Weak suffix ranks by the difference-cover method modulo 3, on numpy arrays.

Triples at positions 1 and 2 modulo 3 are sorted and named; the names, in the order of those positions, are
ranked by recursion; the remaining suffixes are sorted by their first symbol and the rank of the next one;
both are merged. Only the first ``need`` symbols are told apart, so the recursion ends when a name spans
them; suffixes that agree that far may share a rank.
"""

from __future__ import annotations

import numpy as np


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 of a sort key, equal for equal keys."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64) + 1


def _pack(*parts: np.ndarray) -> np.ndarray:
    """One integer that orders like the tuple; parts are made dense first where they would not fit 64 bits."""
    out, bits = parts[0].astype(np.uint64), int(parts[0].max(initial=1)).bit_length()
    for p in parts[1:]:
        width = int(p.max(initial=1)).bit_length()
        if bits + width > 64:
            out = _dense(out).astype(np.uint64)
            bits = int(out.max(initial=1)).bit_length()
        out = out << np.uint64(width) | p.astype(np.uint64)
        bits += width
    return out


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    if max(int(x.max(initial=0)) for x in (a, b, c)) < 257:
        return _dense((a * 66049 + b * 257 + c).astype(np.uint32))
    return _dense(_pack(a, b, c))


def weak_ranks(s: np.ndarray, need: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """A rank for each position of ``s`` (symbols from 1), by its next ``need`` symbols; for ``wanted`` positions only, if given."""
    n = len(s)
    if need <= 1 or n == 0:
        return s.astype(np.int64) if wanted is None else s[wanted].astype(np.int64)
    t = np.zeros(n + 6, np.int64)
    t[:n] = s
    one, two, zero = np.arange(1, n + 3, 3), np.arange(2, n + 3, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names = _names(t[sample], t[sample + 1], t[sample + 2])
    below = -(-need // 3)
    if below > 1 and int(names.max()) < len(names):
        names = weak_ranks(names, below)
    rank = np.zeros(n + 9, np.int64)
    rank[sample] = names
    keep = sample < n
    sample, names = sample[keep], names[keep]
    if wanted is not None:
        zero = wanted[wanted % 3 == 0]
    # order of the remaining suffixes, and how many sample suffixes are less than each
    own = _pack(t[zero], rank[zero + 1])
    low, high = np.zeros(len(zero), np.int64), np.zeros(len(zero), np.int64)
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    for cls, mine, parts in ((first, zero, lambda p: (t[p], rank[p + 1])), (second, zero, lambda p: (t[p], t[p + 1], rank[p + 2]))):
        both = _pack(*(np.concatenate([x, y]) for x, y in zip(parts(cls), parts(mine), strict=True)))
        keys = np.sort(both[: len(cls)])
        low += np.searchsorted(keys, both[len(cls) :], "left")
        high += np.searchsorted(keys, both[len(cls) :], "right")
    counts = np.bincount(names)
    less = np.cumsum(counts) - counts
    tied = high > low
    value = np.zeros(n, np.int64)
    value[sample] = 2 * less[names] + 1
    value[zero] = 2 * low + tied
    minor = np.zeros(n, np.int64)
    minor[zero[~tied]] = _dense(own[~tied])
    at = np.arange(n) if wanted is None else wanted
    return _dense(_pack(value[at], minor[at]))
