"""Statistics that follow in closed form from aggregates already computed per group.

The p-values without a SQL built-in are vectorised over the result rows, one per group; no
tick ever reaches them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import col, ratio


def skew_corrected(x) -> Column:
    """Sample skewness with the small-sample correction; missing below three values."""
    n, g = F.count(col(x)), F.skewness(col(x))
    return F.when(n >= 3, g * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))


def kurt_corrected(x) -> Column:
    """Sample excess kurtosis with the small-sample correction; missing below four values."""
    n, g = F.count(col(x)).cast("double"), F.kurtosis(col(x))
    return F.when(n >= 4, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6))


def normality_k2(n, skew, kurt) -> Column:
    """D'Agostino and Pearson's K² from n, biased skewness and biased excess kurtosis."""
    n, skew, kurt = col(n).cast("double"), col(skew), col(kurt)
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    scaled = F.when(y == 0, F.lit(1.0)).otherwise(y) / F.sqrt(2 / (w2 - 1))
    z_skew = F.ln(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(F.ln(w2) / 2)

    expected = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / F.sqrt(spread)
    root_b1 = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root_b1 * (2 / root_b1 + F.sqrt(1 + 4 / (root_b1 * root_b1)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    cube_root = F.signum(denom) * F.pow(ratio(1 - 2 / a, F.abs(denom)), F.lit(1 / 3))
    z_kurt = (1 - 2 / (9 * a) - cube_root) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z_skew * z_skew + z_kurt * z_kurt)


def chi2_two_df_tail(x) -> Column:
    return F.exp(-col(x) / 2)


def normal_density(x, mean, std) -> Column:
    z = ratio(col(x) - col(mean), col(std))
    return F.exp(-z * z / 2) / (col(std) * math.sqrt(2 * math.pi))


def _log_gamma_step(a: float) -> float:
    """ln of gamma(a + 1/2) / gamma(a), without the cancellation of two large logarithms."""
    shift = 0.0
    while a < 20:  # steps up to where the series below is exact to rounding
        shift += math.log(a / (a + 0.5))
        a += 1
    r = 1 / (a * a)
    series = (-1 / 8 + r * (1 / 192 + r * (-1 / 640 + r * (17 / 14336 + r * (-31 / 18432))))) / a
    return shift + 0.5 * math.log(a) + series


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)
_PANELS = 24


def _student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, one formula for every df of one or more.

    With t = sqrt(df) tan(a) the tail is an integral of cos(a) ** (df - 1), taken from the angle of t to where the
    integrand has fallen by e^45, by Gauss's rule on equal panels. Nothing cancels, however large df is.
    """
    if t == 0 and df > 0:
        return 1.0
    if not (math.isfinite(t) and df > 0):
        return 0.0 if math.isinf(t) and df > 0 else math.nan
    square = t * t / df
    start = math.atan(math.sqrt(square))
    fall = math.log1p(square) + (90 / (df - 1) if df > 1 else math.inf)
    stop = math.atan(math.sqrt(math.expm1(fall))) if fall < 600 else math.pi / 2
    edges = np.linspace(start, stop, _PANELS + 1)
    half = np.diff(edges)[:, None] / 2
    tangent = np.tan(edges[:-1, None] + half * (1 + _NODES))
    inside = float((half * _WEIGHTS * np.exp(-(df - 1) / 2 * np.log1p(tangent * tangent))).sum())
    return min(1.0, 2 * inside * math.exp(_log_gamma_step(df / 2)) / math.sqrt(math.pi))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return pd.Series([_student_tail(float(a), float(b)) for a, b in zip(t, df)])


# MacKinnon's (1994) response surface for one series with a constant.
TAU_SPLIT = -1.61
TAU_LOWEST = -18.83
TAU_HIGHEST = 2.74
TAU_SMALL_P = (2.1659, 1.4412, 0.038269)
TAU_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    """p-value of an augmented Dickey–Fuller statistic, regression with a constant."""
    if not math.isfinite(stat):
        return math.nan
    if stat > TAU_HIGHEST:
        return 1.0
    if stat < TAU_LOWEST:
        return 0.0
    terms = TAU_SMALL_P if stat <= TAU_SPLIT else TAU_LARGE_P
    z = float(np.polynomial.polynomial.polyval(stat, terms))
    return math.erfc(-z / math.sqrt(2)) / 2
