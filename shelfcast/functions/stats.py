"""Distribution functions needed by stock and residual formulas."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 for normal percentage points (Applied
# Statistics 37, 1988), highest power first: numerator and denominator near the centre, in the
# tails, and in the far tails.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.74545014278341407640e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.148103976427480074590,
     0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.00124266094738807843860, 0.0265321895265761230930,
     0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     0.0148753612908506148525, 0.136929880922735805310, 0.599832206555887937690, 1.0),
)
CENTRE_REACH, TAIL_SHIFT, FAR_SHIFT = 0.425, 1.6, 5.0


def z_value(level: float) -> float:
    """Normal quantile of one fixed level, worked out once on the driver."""
    return NormalDist().inv_cdf(level)


def _polynomial(coefficients, x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _rational(pair, x: Column) -> Column:
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF of a per-row level in (0, 1) to double precision; null outside."""
    q = p - F.lit(0.5)
    near = q * _rational(CENTRE, F.lit(CENTRE_REACH**2) - q * q)
    depth = F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))
    size = F.when(depth <= FAR_SHIFT, _rational(TAIL, depth - F.lit(TAIL_SHIFT))).otherwise(
        _rational(FAR_TAIL, depth - F.lit(FAR_SHIFT))
    )
    outer = F.when(q < 0, -size).otherwise(size)
    inside = F.coalesce((p > 0) & (p < 1), F.lit(False))
    return F.when(inside, F.when(F.abs(q) <= CENTRE_REACH, near).otherwise(outer))


def chi_square_tail(x: Column, degrees: int) -> Column:
    """P(chi-square > x) for an even number of degrees of freedom (closed form)."""
    if degrees % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    half = x / F.lit(2.0)
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, degrees // 2):
        term = term * half / F.lit(float(k))
        total = total + term
    return F.exp(-half) * total


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation over n pairs."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return math.nan
    rest = 1.0 - r * r
    return 0.0 if rest <= 0 else incomplete_beta((n - 2) / 2.0, 0.5, rest)


STEPS = 400


def _cosine_integral(power: Column, low: Column) -> Column:
    """Integral of cos(t) ** power from ``low`` to pi / 2 by Simpson's rule, cut where nothing is left to add."""
    high = F.least(F.pi() / 2, F.sqrt(low * low + F.lit(80.0) / F.greatest(power, F.lit(1.0))))
    step = (high - low) / F.lit(float(STEPS))

    def weighted(total: Column, k: Column) -> Column:
        weight = F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * F.pow(F.cos(low + k * step), power)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), weighted) * step / F.lit(3.0)


def correlation_p_value_column(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation r over n pairs as an expression; NaN for n under 3.

    With r = sin(t) the density of t over n pairs is proportional to cos(t) ** (n - 3), so the value is
    the share of that integral beyond asin(|r|).
    """
    power = (n - F.lit(3)).cast("double")
    share = _cosine_integral(power, F.asin(F.least(F.abs(r), F.lit(1.0)))) / _cosine_integral(power, F.lit(0.0))
    usable = r.isNotNull() & ~F.isnan(r) & (n >= 3)
    return F.when(usable, F.least(share, F.lit(1.0))).otherwise(F.lit(float("nan")))
