"""Upper tails of the normal, Student and chi-squared distributions as Spark expressions.

Each tail is its leading factor times an integral over the half line of a positive, smooth function.
With s = exp(y - exp(-y)) the trapezoid rule over y converges so fast that a few hundred fixed points give
about twelve digits, in the far tail as well, where nothing is subtracted from 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST, STEP = -5.0, 7.0, 0.03
SHIFT = 32   # the series of the gamma ratio is used from here on


def half_line(log_integrand: Callable[[Column], Column]) -> Column:
    """Integral of exp(log_integrand(s)) for s from 0 to infinity."""
    points = F.sequence(F.lit(0), F.lit(int((HIGHEST - LOWEST) / STEP)))

    def add(total: Column, k: Column) -> Column:
        y = k * F.lit(STEP) + F.lit(LOWEST)
        s = F.greatest(F.exp(y - F.exp(-y)), F.lit(1e-300))
        return total + F.exp(log_integrand(s)) * s * (F.lit(1.0) + F.exp(-y)) * F.lit(STEP)

    return F.aggregate(points, F.lit(0.0), add)


def normal_upper(z: Column) -> Column:
    """P(Z > z) of the standard normal."""
    size = F.abs(z)
    tail = F.exp(-size * size / 2.0) * F.lit(1.0 / math.sqrt(2.0 * math.pi)) * half_line(
        lambda s: -(size * s) - s * s / 2.0)
    return F.when(F.isnan(z), F.lit(float("nan"))).when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def log_gamma_ratio(a: Column) -> Column:
    """log of gamma(a + 1/2) / gamma(a), a > 0."""
    far = a + F.lit(float(SHIFT))
    series = F.log(far) / 2.0 - 1.0 / (8.0 * far) + 1.0 / (192.0 * F.pow(far, F.lit(3))) - 1.0 / (640.0 * F.pow(far, F.lit(5)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), series,
                       lambda total, k: total + F.log(a + k) - F.log(a + k + 0.5))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    a = df / F.lit(2.0)
    log_x = -F.log1p(t * t / df)
    # Beyond the reach of e^-s the integrand vanishes; the root keeps its digits for large df.
    inner = half_line(lambda s: -s - F.log(-F.expm1(log_x - s / a)) / 2.0)
    tail = F.exp(a * log_x + log_gamma_ratio(a)) / (a * F.lit(math.sqrt(math.pi))) * inner
    return F.when(t.isNotNull() & df.isNotNull(), F.least(F.lit(1.0), tail))


def chi2_upper(x: Column, df: Column) -> Column:
    """P(X > x) with the whole number ``df`` >= 1 of degrees of freedom."""
    a, half = df / F.lit(2.0), x / F.lit(2.0)
    odd = df % 2 == 1
    first = F.when(odd, F.lit(math.log(math.pi) / 2.0)).otherwise(F.lit(0.0))
    below = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(a).cast("int"))), lambda k: k < a)
    log_gamma = F.aggregate(below, first, lambda total, k: total + F.log(
        F.when(odd, k - F.lit(0.5)).otherwise(k.cast("double"))))
    front = (a - 1.0) * F.log(half) - half - log_gamma
    tail = half_line(lambda s: front - s + (a - 1.0) * F.log1p(s / half))
    return F.when(half <= 0, F.lit(1.0)).when(half > 0, F.least(F.lit(1.0), tail))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t approximation; NULL without a correlation, NaN below three rows."""
    free = (n - 2).cast("double")
    size = F.sqrt(free / (F.lit(1.0) - rho * rho)) * rho
    return F.when(n < 3, F.lit(float("nan"))).when(F.abs(rho) >= 1.0, F.lit(0.0)).otherwise(student_two_sided(size, free))


def mannwhitney_upper(u: Column, n1: Column, n2: Column, tie_sum: Column) -> Column:
    """One-sided p for "first group larger": normal approximation, tie and half-step corrected."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    n = n1 + n2
    spread = n1 * n2 / 12.0 * ((n + 1.0) - F.try_divide(tie_sum, n * (n - 1.0)))
    z = (u - n1 * n2 / 2.0 - 0.5) / F.sqrt(F.when(spread > 0, spread))
    return F.when(spread > 0, normal_upper(z)).otherwise(F.when(n >= 0, F.lit(float("nan"))))
