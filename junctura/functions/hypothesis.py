"""Two-sample tests and a bimodality index."""

from __future__ import annotations

import math

import numpy as np

from .special import normal_sf, student_two_sided


def welch(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided p-value of Welch's t; NaN for equal constants."""
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    diff = a.mean() - b.mean()
    if va + vb == 0:
        return math.nan if diff == 0 else 0.0
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return student_two_sided(diff / math.sqrt(va + vb), df)


def _ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2)[inverse]


def mann_whitney(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided: exact for small samples without ties, else normal with tie and continuity correction."""
    n, m = len(a), len(b)
    both = np.concatenate([a, b])
    u = _ranks(both)[:n].sum() - n * (n + 1) / 2
    u = max(u, n * m - u)
    counts = np.unique(both, return_counts=True)[1]
    if min(n, m) <= 8 and len(counts) == n + m:
        ways = np.zeros((n + 1, n * m + 1))
        ways[0, 0] = 1
        for value in range(1, n + m + 1):  # choose n of the ranks, by their sum of excess
            for k in range(min(n, value), 0, -1):
                shift = value - k
                if shift <= n * m:
                    ways[k, shift:] += ways[k - 1, : n * m + 1 - shift]
        p = ways[n] / ways[n].sum()
        return float(min(1.0, 2 * p[int(u) :].sum()))
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - (counts**3 - counts).sum() / (total * (total - 1))))
    return math.nan if sd == 0 else min(1.0, 2 * normal_sf((u - n * m / 2 - 0.5) / sd))


def dip(x: np.ndarray, bins: int = 200) -> float:
    """Share of histogram bins that are valleys."""
    if len(x) < 4:
        return 0.0
    h = np.histogram(x, bins=min(bins, len(np.unique(x))))[0]
    valleys = int(((h[1:-1] < h[:-2]) & (h[1:-1] < h[2:])).sum())
    return min(1.0, valleys / max(1, len(h) // 2))


def bimodality(x: np.ndarray) -> float:
    return 1.0 if len(x) < 4 else min(1.0, math.exp(-max(0.0, dip(x) - 0.1) * math.sqrt(len(x))))
