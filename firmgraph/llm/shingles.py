"""Word shingles and their similarity, in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(values: np.ndarray, lengths: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of several word sequences that lie one after the other, and the sequence of each.

    A sequence with fewer words than a shingle has one shingle of all its words; an empty one has none.
    """
    w = values.astype(np.int64).view(np.uint64)
    n = len(w)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(ends, lengths) - np.arange(n)  # words from here to the end of the sequence
    h = mix(w + _GOLD)
    for j in range(1, width):
        nxt = np.zeros(n, np.uint64)
        nxt[: max(0, n - j)] = w[j:]
        h = np.where(left > j, mix(h * np.uint64(3) + nxt), h)
    first = np.arange(n) == np.repeat(ends - lengths, lengths)
    good = (left >= width) | (first & (np.repeat(lengths, lengths) < width))
    return h[good], doc[good]


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, shingle) with their counts, by doc and hash."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def union_weights(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both sides over the union of two sorted sets of shingles, 0 where one lacks it."""
    h = np.union1d(ha, hb)
    a, b = np.zeros(len(h)), np.zeros(len(h))
    a[np.searchsorted(h, ha)] = wa
    b[np.searchsorted(h, hb)] = wb
    return a, b


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum over common d of 1 / sum over d' of max(a[d'] / a[d], b[d'] / b[d]), by sorting the ratios."""
    both = (a > 0) & (b > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    below = np.concatenate([[0.0], np.cumsum(b[order])])
    above = np.concatenate([np.cumsum(a[order][::-1])[::-1], [0.0]])
    at = np.searchsorted(r, ratio[both], "left")
    return float((1 / (above[at] / a[both] + below[at] / b[both])).sum())


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    top = np.maximum(a, b).sum()
    return float(np.minimum(a, b).sum() / top) if top else 0.0
