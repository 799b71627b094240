"""p-values from a handful of test statistics. Scalars only; runs where the result is read."""

from __future__ import annotations

import math

_TINY = 1e-300


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + top / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2.0, 0.5, df / (df + t * t))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t approximation."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    return student_two_sided(rho * math.sqrt((n - 2) / (1.0 - rho * rho)), n - 2)


def chi2_upper(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution."""
    a, half = df / 2.0, x / 2.0
    if half <= 0.0:
        return 1.0
    log_front = a * math.log(half) - half - math.lgamma(a)
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= half / k
            total += term
        return 1.0 - math.exp(log_front) * total
    b = half + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    value = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_front) * value


def mannwhitney_upper(u: float, n1: int, n2: int, tie_sum: float) -> float:
    """One-sided p for "first group larger": normal approximation, tie and half-step corrected."""
    n = n1 + n2
    spread = n1 * n2 / 12.0 * ((n + 1) - tie_sum / (n * (n - 1.0)))
    if spread <= 0.0:
        return float("nan")
    return normal_upper((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(spread))
