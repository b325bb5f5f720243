"""Distribution functions for results that are already a few numbers."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t)."""
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_quantile(q: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_upper_tail(mid, df) < q else (lo, mid)
    return (lo + hi) / 2


def kolmogorov_two_sided(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    if d <= 0:
        return 1.0
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def wilcoxon_exact(ranks: list[float], statistic: float) -> float:
    """Two-sided p-value of the signed-rank statistic min(W+, W-), by counting
    sign patterns over the ranks (ties share mid-ranks, so they are doubled)."""
    counts = {0: 1}
    for r in ranks:
        step = round(2 * r)
        new = dict(counts)
        for k, n in counts.items():
            new[k + step] = new.get(k + step, 0) + n
        counts = new
    below = sum(n for k, n in counts.items() if k <= round(2 * statistic))
    return min(1.0, 2 * below / 2 ** len(ranks))
