"""Special functions as column expressions (the engine has neither erfc nor lgamma)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of formula 7.1.26 of Abramowitz and Stegun for erf.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Lanczos coefficients (g = 7, n = 9) for the gamma function.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)

EPS = 1e-9


def erfc(x: Column) -> Column:
    """Complementary error function, absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + ERFC_P * a)
    p = F.lit(0.0)
    for c in reversed(ERFC_A):
        p = (p + c) * t
    y = p * F.exp(-a * a)
    return F.when(x < 0, 2 - y).otherwise(y)


def erf(x: Column) -> Column:
    return 1 - erfc(x)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def normal_sf(z: Column) -> Column:
    return 0.5 * erfc(z / math.sqrt(2))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_logcdf(z: Column) -> Column:
    return F.log(F.greatest(normal_cdf(z), F.lit(1e-300)))


def normal_logsf(z: Column) -> Column:
    return F.log(F.greatest(normal_sf(z), F.lit(1e-300)))


def two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def one_sided(z: Column, greater: bool = True) -> Column:
    p = normal_sf(z)
    return p if greater else 1 - p


def t_two_sided(t: Column) -> Column:
    """Two-sided p of a t statistic by the normal distribution."""
    return two_sided(t)


def chisq_sf(x: Column, df: Column | int) -> Column:
    """Upper tail of the chi-squared distribution after Wilson and Hilferty."""
    d = df if isinstance(df, Column) else F.lit(float(df))
    s = 2 / (9 * d)
    z = (F.cbrt(x / d) - (1 - s)) / F.sqrt(s)
    return F.when((d <= 0) | (x <= 0), F.lit(1.0)).otherwise(normal_sf(z))


def f_sf(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of the F distribution by cube roots of the beta-scaled ratio."""
    lam = df1 * f / (df1 * f + df2)
    a, b = 2 / (9 * df1), 2 / (9 * df2)
    z = (F.cbrt(lam) - (1 - a)) / F.sqrt(a) - (F.cbrt(1 - lam) - (1 - b)) / F.sqrt(b)
    return F.when((df1 <= 0) | (df2 <= 0) | (f <= 0), F.lit(1.0)).otherwise(normal_sf(z))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    z = x - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(s)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def hypergeom_sf(k: Column, n: Column, big_k: Column, big_n: Column) -> Column:
    """P(X >= k) when n are drawn from big_n of which big_k count; summed term by term."""
    hi = F.least(n, big_k)
    terms = F.transform(F.sequence(k.cast("int"), hi.cast("int")), lambda i: F.exp(log_choose(big_k.cast("double"), i.cast("double")) + log_choose((big_n - big_k).cast("double"), (n - i).cast("double")) - log_choose(big_n.cast("double"), n.cast("double"))))
    total = F.aggregate(F.filter(terms, lambda t: ~F.isnan(t)), F.lit(0.0), lambda a, t: a + t)
    return F.when(k <= 0, F.lit(1.0)).when(k > hi, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def log2_fold_change(mean1: Column, mean2: Column, eps: float = EPS) -> Column:
    """log2 of mean2 over mean1, both raised by a small constant."""
    return F.log2((mean2 + eps) / (mean1 + eps))
