"""Incomplete beta and gamma functions, and the tails built on them."""

from __future__ import annotations

import math

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid):
            low = mid
        else:
            high = mid
        if high - low <= 1e-16 * max(1.0, abs(high)):
            break
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_cdf(x, a, b) < p, 0.0, 1.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    high = 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    return _bisect(lambda t: 1 - t_two_sided(t, df) / 2 < p, 0.0, high)


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x): the upper regularised incomplete gamma."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + num / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Sum of outcomes no more probable than the one seen.

    Probabilities fall on either side of the mode, so both tails are found by
    search and summed by the incomplete beta, however large n is.
    """
    def log_p(i: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0) + ((n - i) * math.log1p(-p) if n - i else 0)

    def at_least(i: int) -> float:
        return 1.0 if i <= 0 else 0.0 if i > n else beta_cdf(p, i, n - i + 1)

    def at_most(i: int) -> float:
        return 0.0 if i < 0 else 1.0 if i >= n else beta_cdf(1 - p, n - i, i + 1)

    if k == p * n:
        return 1.0
    limit = log_p(k) + 1e-7
    mode = min(n, int((n + 1) * p))
    if k < p * n:
        low, high = max(mode, k), n + 1  # the first place above the mode that is rare enough
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if log_p(mid) <= limit else (mid + 1, high)
        return min(1.0, at_most(k) + at_least(low))
    low, high = -1, min(mode, k)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if log_p(mid) <= limit else (low, mid - 1)
    return min(1.0, at_least(k) + at_most(low))
