"""Numbers that neither Spark nor NumPy has: assignment, t quantile, exact signed-rank test, Holm."""

from __future__ import annotations

import math

import numpy as np


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest perfect matching of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    row_of = np.full(n, -1)
    pu, pv = np.zeros(n), np.zeros(n)
    for start in range(n):
        reach, came = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        row, at, base = start, -1, 0.0
        while True:
            slack = base + cost[row] - pu[row] - pv
            better = ~done & (slack < reach)
            reach[better], came[better] = slack[better], at
            at = int(np.argmin(np.where(done, np.inf, reach)))
            base, done[at] = reach[at], True
            if row_of[at] < 0:
                break
            row = row_of[at]
        pu[start] += base
        for c in np.flatnonzero(done & (row_of >= 0)):
            pu[row_of[c]] += base - reach[c]
            pv[c] -= base - reach[c]
        while at >= 0:
            row_of[at] = start if came[at] < 0 else row_of[came[at]]
            at = came[at]
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def first_matching(gain: np.ndarray) -> list[int]:
    """Column of each row (-1: none) in a matching of as many pairs as fit with the largest sum of whole numbers ``gain``.

    Of equal ones the first in order of columns, row by row, no column last: row after row takes the first column with which
    the rest still reaches the best sum.
    """
    rows, cols = gain.shape

    def best(some: list[int], free: list[int], pairs: int) -> float:
        # surplus rows and columns meet columns and rows of their own at no gain; a missing pair costs more than all gains
        size = max(len(some), len(free))
        if not size:
            return 0.0 if pairs <= 0 else -math.inf
        if min(len(some), len(free)) < pairs:
            return -math.inf
        full = np.zeros((size, size))
        full[: len(some), : len(free)] = gain[np.ix_(some, free)]
        pick = best_assignment(-full)
        return float(full[range(size), pick].sum())

    every, free, out = list(range(rows)), list(range(cols)), []
    pairs, target = min(rows, cols), best(every, list(range(cols)), min(rows, cols))
    for i in every:
        rest = every[i + 1 :]
        for j in [*free, -1]:
            left = [c for c in free if c != j]
            need = pairs - (j >= 0)
            if best(rest, left, need) + (gain[i, j] if j >= 0 else 0) == target:
                out.append(j)
                free, pairs, target = left, need, target - (gain[i, j] if j >= 0 else 0)
                break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        k = i // 2
        num = 1.0 if i == 0 else (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if i % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    p = beta_inc(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - p if t > 0 else p


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_interval(values, level: float = 0.95) -> tuple[float, float, float]:
    """Mean and its interval over the finite values; NaN bounds for fewer than two, all NaN without any."""
    v = np.array([x for x in values if math.isfinite(x)], float)
    if not len(v):
        return (math.nan,) * 3
    mean = float(v.mean())
    if len(v) < 2:
        return mean, math.nan, math.nan
    half = t_quantile((1 + level) / 2, len(v) - 1) * float(v.std(ddof=1)) / math.sqrt(len(v))
    return mean, mean - half, mean + half


def mid_ranks(values) -> np.ndarray:
    v = np.asarray(values, float)
    _, inv, counts = np.unique(v, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return ((2 * ends - counts + 1) / 2)[inv]


def signed_rank(diffs) -> tuple[float, float]:
    """(W+, exact two-sided p): differences within 1e-12 are zeros and dropped, sizes are compared at 12 decimals.

    The null distribution is built by polynomial products over doubled mid-ranks; p is 1 without differences.
    """
    d = np.array([x for x in diffs if not math.isnan(x) and abs(x) > 1e-12])
    if not len(d):
        return 0.0, 1.0
    w, ways = _null_ways(d)
    low, high = ways[: w + 1].sum(), ways[w:].sum()
    return w / 2, float(min(1.0, 2 * min(low, high) / 2.0 ** len(d)))


def _null_ways(d: np.ndarray) -> tuple[int, np.ndarray]:
    """Twice W+, and how many sign patterns give each doubled rank sum. Infinite sizes rank last, together."""
    twice = np.rint(2 * mid_ranks(np.round(np.abs(d), 12))).astype(int)
    ways = np.zeros(twice.sum() + 1)
    ways[0] = 1.0
    for r in twice:
        ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
    return int(twice[d > 0].sum()), ways


def signed_rank_auto(diffs, greater: bool = False) -> float:
    """Signed-rank p in the common form: exact up to 50 differences without zeros and ties, else normal with tie correction.

    Two-sided, or for differences over zero. NaN where no difference is left.
    """
    every = [x for x in diffs if not math.isnan(x)]
    d = np.array([x for x in every if x != 0.0])
    if not len(d) or np.all(np.abs(d) <= 1e-12):
        return math.nan
    sizes, counts = np.unique(np.abs(d), return_counts=True)
    if len(every) <= 50 and len(sizes) == len(every):
        twice = np.rint(2 * mid_ranks(np.abs(d))).astype(int)
        ways = np.zeros(twice.sum() + 1)
        ways[0] = 1.0
        for r in twice:
            ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
        w = int(twice[d > 0].sum())
        low, high = ways[: w + 1].sum() / 2.0 ** len(d), ways[w:].sum() / 2.0 ** len(d)
        return float(high if greater else min(1.0, 2 * min(low, high)))
    n, w = len(d), float(mid_ranks(np.abs(d))[d > 0].sum())
    var = (n * (n + 1) * (2 * n + 1) - float((counts**3 - counts).sum()) / 2) / 24
    z = (w - n * (n + 1) / 4) / math.sqrt(var)
    return math.erfc(z / math.sqrt(2)) / 2 if greater else math.erfc(abs(z) / math.sqrt(2))


def holm(ps) -> list[float]:
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, top = [0.0] * len(ps), 0.0
    for k, i in enumerate(order):
        top = max(top, min(1.0, (len(ps) - k) * ps[i]))
        out[i] = top
    return out


def spearman(a, b) -> tuple[float, float]:
    """Rank correlation and its two-sided p by the t approximation."""
    r = float(np.corrcoef(mid_ranks(a), mid_ranks(b))[0, 1])
    df = len(a) - 2
    if df < 1 or abs(r) >= 1:
        return r, 0.0 if df >= 1 else math.nan
    return r, 2 * (1 - t_cdf(abs(r) * math.sqrt(df / (1 - r * r)), df))
