"""Distributions and tests of two groups, from sufficient statistics.

Pure Python on the driver: every input is a handful of numbers that Spark has
aggregated. Tails come from complementary functions, so small p-values hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from tallywell.functions.special import beta_quantile, binomial_two_sided, chi2_tail, t_quantile, t_two_sided


class StatInputError(ValueError):
    pass


def z_of(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _result(kind: str, value: float, ci, p: float, statistic: dict, **more) -> dict:
    return {"effect": {"type": kind, "value": value, "ci": ci}, "p_value": p, "statistic": statistic, **more}


def _check_counts(s_a, n_a, s_b, n_b) -> None:
    if min(n_a, n_b) <= 0 or not (0 <= s_a <= n_a and 0 <= s_b <= n_b):
        raise StatInputError("counts need 0 <= successes <= total and a total above 0")


def two_proportion(s_a: int, n_a: int, s_b: int, n_b: int, alpha: float = 0.05) -> dict:
    _check_counts(s_a, n_a, s_b, n_b)
    p_a, p_b = s_a / n_a, s_b / n_b
    pool = (s_a + s_b) / (n_a + n_b)
    se = math.sqrt(pool * (1 - pool) * (1 / n_a + 1 / n_b))
    z = (p_a - p_b) / se if se else 0.0
    wide = z_of(1 - alpha / 2) * math.sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b)
    d = p_a - p_b
    return _result("diff_proportion", d, [d - wide, d + wide], normal_two_sided(z), {"z": z})


def welch(n_a: int, mean_a: float, var_a: float, n_b: int, mean_b: float, var_b: float, alpha: float = 0.05) -> dict:
    if min(n_a, n_b) < 2:
        raise StatInputError("a group needs two values")
    a, b = var_a / n_a, var_b / n_b
    se = math.sqrt(a + b)
    if not se:
        raise StatInputError("both groups are constant")
    df = (a + b) ** 2 / (a * a / (n_a - 1) + b * b / (n_b - 1))
    d = mean_a - mean_b
    wide = t_quantile(1 - alpha / 2, df) * se
    return _result("diff_mean", d, [d - wide, d + wide], t_two_sided(d / se, df), {"t": d / se, "df": df})


#: Cells of the exact distribution of U; beyond, with one group of at most 8 values, a limit of it is used.
EXACT_CELLS = 200_000


def mann_whitney(u: float, n: int, m: int, tie_sum: float, shift: float) -> dict:
    """From U of the first group, sizes, sum of t^3 - t over ties, and the Hodges-Lehmann shift.

    Exact for untied groups of which one has at most 8 values, else the normal
    approximation with ties and continuity corrected.
    """
    if min(n, m) < 1:
        raise StatInputError("a group is empty")
    if not tie_sum and min(n, m) <= 8:
        p = _exact_u(max(u, n * m - u), min(n, m), max(n, m))
    else:
        total = n + m
        var = n * m / 12 * (total + 1 - tie_sum / (total * (total - 1)))
        p = normal_two_sided(max(0.0, max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(var)) if var > 0 else 1.0
    return _result("hodges_lehmann", shift, None, min(1.0, p), {"u": u, "rank_biserial": 2 * u / (n * m) - 1})


def _exact_u(u: float, n: int, m: int) -> float:
    """P(U >= u or U <= nm - u) of untied groups, n <= m.

    Up to EXACT_CELLS values of U their counts are the coefficients of a
    Gaussian binomial. Beyond, the values of the small group are uniform places
    among the large one's, so that U has the distribution of a sum of n uniform
    variables, widened to U's variance; that is off by about one part in m.
    """
    if n * m > EXACT_CELLS:
        at = n / 2 - (u - 0.5 - n * m / 2) / math.sqrt(m * (n + m + 1))
        return 2 * math.fsum((-1) ** k * math.comb(n, k) * (at - k) ** n for k in range(n + 1) if k < at) / math.factorial(n) if at > 0 else 0.0
    counts = [1] + [0] * (n * m)
    for i in range(1, n + 1):  # times (1 - q^(m + i)) / (1 - q^i)
        for s in range(n * m, m + i - 1, -1):
            counts[s] -= counts[s - m - i]
        for s in range(i, n * m + 1):
            counts[s] += counts[s - i]
    return 2 * sum(counts[math.ceil(u):]) / math.comb(n + m, n)


def fisher(s_a: int, n_a: int, s_b: int, n_b: int) -> dict:
    _check_counts(s_a, n_a, s_b, n_b)
    hits, total = s_a + s_b, n_a + n_b

    def log_p(k: int) -> float:
        return _log_choose(n_a, k) + _log_choose(n_b, hits - k) - _log_choose(total, hits)

    seen = log_p(s_a)
    p = math.fsum(math.exp(x) for k in range(max(0, hits - n_b), min(n_a, hits) + 1) if (x := log_p(k)) <= seen + 1e-7)
    cross = s_b * (n_a - s_a)
    odds = s_a * (n_b - s_b) / cross if cross else (math.inf if s_a * (n_b - s_b) else math.nan)
    return _result("odds_ratio", odds, None, min(1.0, p), {"odds_ratio": odds})


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def poisson_rates(e_a: int, x_a: float, e_b: int, x_b: float, alpha: float = 0.05) -> dict:
    if min(x_a, x_b) <= 0 or min(e_a, e_b) < 0 or e_a + e_b == 0:
        raise StatInputError("rates need exposures above 0 and an event")
    total, share = e_a + e_b, x_a / (x_a + x_b)
    low = 0.0 if e_a == 0 else beta_quantile(alpha / 2, e_a, total - e_a + 1)
    high = 1.0 if e_a == total else beta_quantile(1 - alpha / 2, e_a + 1, total - e_a)
    ratio = (e_a / x_a) / (e_b / x_b) if e_b else math.inf
    ci = [low / (1 - low) * x_b / x_a, math.inf if high >= 1 else high / (1 - high) * x_b / x_a]
    return _result("rate_ratio", ratio, ci, binomial_two_sided(e_a, total, share), {"events": total}, unchecked=["overdispersion"])


def negative_binomial(e_a: int, x_a: float, e_b: int, x_b: float, alpha: float = 0.05) -> dict:
    """Log-link model of two rows with dispersion 1, in closed form."""
    if min(x_a, x_b) <= 0 or min(e_a, e_b) <= 0:
        raise StatInputError("rates need exposures and events above 0")
    beta = math.log((e_a / x_a) / (e_b / x_b))
    se = math.sqrt((1 + e_a) / e_a + (1 + e_b) / e_b)
    wide = z_of(1 - alpha / 2) * se
    return _result("rate_ratio", math.exp(beta), [math.exp(beta - wide), math.exp(beta + wide)], normal_two_sided(beta / se), {"z": beta / se})


def chi2_fit(observed: list[float], expected: list[float]) -> tuple[float, float]:
    chi2 = math.fsum((o - e) ** 2 / e for o, e in zip(observed, expected, strict=True))
    return chi2, chi2_tail(chi2, len(observed) - 1)


def required_per_group(baseline: float, mde: float, alpha: float = 0.05, power: float = 0.8) -> int:
    if mde <= 0:
        raise ValueError("mde must be positive")
    other = min(1.0, max(0.0, baseline + mde))
    mid = (baseline + other) / 2
    root = z_of(1 - alpha / 2) * math.sqrt(2 * mid * (1 - mid)) + z_of(power) * math.sqrt(
        baseline * (1 - baseline) + other * (1 - other))
    return math.ceil(root**2 / mde**2)


def detectable(n_a: int, n_b: int, rate: float, alpha: float = 0.05, power: float = 0.8) -> float | None:
    if min(n_a, n_b) <= 0:
        return None
    rate = min(1.0, max(0.0, rate))
    return round((z_of(1 - alpha / 2) + z_of(power)) * math.sqrt(rate * (1 - rate) * (1 / n_a + 1 / n_b)), 6)


def k_squared(n: int, skew: float, kurt: float) -> tuple[float, float]:
    """D'Agostino's test from biased skewness and excess kurtosis."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    a = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(y / a) / math.sqrt(math.log(w2) / 2)
    mean = -6 / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    d = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    q = (1 - 2 / d) / (1 + x * math.sqrt(2 / (d - 4)))
    z2 = (1 - 2 / (9 * d) - math.copysign(abs(q) ** (1 / 3), q)) / math.sqrt(2 / (9 * d))
    k2 = z1 * z1 + z2 * z2
    return k2, chi2_tail(k2, 2)


def expected_order(i: int, n: int) -> float:
    """About where the i-th least of n standard normal values lies."""
    return NormalDist().inv_cdf((i - 0.375) / (n + 0.25))


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and its p-value by Royston's approximation, for 3 to 5000 values."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        raise StatInputError("normality needs three values that differ")
    m = [expected_order(i, n) for i in range(1, n + 1)]
    mean = math.fsum(x) / n
    return shapiro_of_sums(n, math.fsum(v * v for v in m), math.fsum(p * q for p, q in zip(m, x, strict=True)), x[:2], x[:-3:-1], math.fsum((v - mean) ** 2 for v in x))


def shapiro_of_sums(n: int, mm: float, mx: float, low: Sequence[float], high: Sequence[float], squares: float) -> tuple[float, float]:
    """The same from sums over ranks: of squared expected places, of places times values, and of squares about the mean.

    ``low`` are the least two values, ``high`` the greatest two, the outmost first.
    """
    if n < 3 or low[0] == high[0]:
        raise StatInputError("normality needs three values that differ")
    u = 1 / math.sqrt(n)

    def poly(c, v):
        return sum(k * v**i for i, k in enumerate(c))

    top = [expected_order(n - i, n) for i in range(2)]
    if n == 3:
        ends, inner = [math.sqrt(0.5)], 0.0
    else:
        ends = [poly((0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), u) + top[0] / math.sqrt(mm)]
        if n > 5:
            ends.append(poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u) + top[1] / math.sqrt(mm))
        k = len(ends)
        phi = (mm - 2 * sum(t * t for t in top[:k])) / (1 - 2 * sum(e * e for e in ends))
        inner = (mx - sum(t * (h - w) for t, h, w in zip(top[:k], high, low, strict=False))) / math.sqrt(phi)
    w = min(1.0, (inner + sum(e * (h - v) for e, h, v in zip(ends, high, low, strict=False))) ** 2 / squares)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return w, 1.0
    y, ln = math.log(1 - w), math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-99
        y = -math.log(g - y)
        mu, sd = poly((0.5440, -0.39978, 0.025054, -6.714e-4), n), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        mu, sd = poly((-1.5861, -0.31082, -0.083751, 0.0038915), ln), math.exp(poly((-0.4803, -0.082676, 0.0030302), ln))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))


