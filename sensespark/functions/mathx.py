"""Scalar and array functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the divisor's literal that trend angles are defined with.
HALF_TURN = 3.141592
#: Range and number of points of the fast mode's grid.
FAST_LIMIT = 8.0
FAST_POINTS = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; null elements for the zero vector."""
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: F.try_divide(x, n))


def cosine(a: Column, b: Column) -> Column:
    """Null, which ranks nowhere, if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def _interpolated(f, x: Column) -> Column:
    """``f`` on the straight lines between the grid's points; a cell's ends are computed, so no table is shipped."""
    step = 2 * FAST_LIMIT / (FAST_POINTS - 1)
    cell = F.least(F.floor((x + FAST_LIMIT) / step), F.lit(FAST_POINTS - 2))
    low, high = f(cell * step - FAST_LIMIT), f((cell + 1) * step - FAST_LIMIT)
    return low + (high - low) * ((x + FAST_LIMIT) / step - cell)


def fast_sigmoid(x: Column) -> Column:
    """The fast mode: interpolated, 0 and 1 from the limits on."""
    return F.when(x >= FAST_LIMIT, 1.0).when(x <= -FAST_LIMIT, 0.0).otherwise(_interpolated(sigmoid, x))


def fast_log_sigmoid(x: Column) -> Column:
    """The fast mode: interpolated, 0 and x itself from the limits on."""
    return F.when(x >= FAST_LIMIT, 0.0).when(x <= -FAST_LIMIT, x).otherwise(_interpolated(log_sigmoid, x))


def beta_mean(a: Column, b: Column) -> Column:
    return a / (a + b)


def digamma(x: Column) -> Column:
    """For x > 0: recurrence up to 6, then the asymptotic series."""
    shifted = x + 6
    series = F.log(shifted) - 1 / (2 * shifted)
    power = 1 / (shifted * shifted)
    for numerator, denominator, k in ((1, 12, 1), (-1, 120, 2), (1, 252, 3), (-1, 240, 4), (5, 660, 5), (-691, 32760, 6)):
        series = series - F.lit(numerator / denominator) * F.pow(power, F.lit(k))
    for i in range(6):
        series = series - 1 / (x + i)
    return series


def expected_log_beta(a: Column, b: Column) -> Column:
    return digamma(a) - digamma(a + b)


def natural_key(value: Column) -> Column:
    """Digit groups as numbers; comparing the arrays is natural order."""
    return F.transform(F.split(value, "[^0-9]"), lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(x.try_cast("bigint")))


def angle(slope: Column, epochs: Column) -> Column:
    """A trend's slope over all epochs, in whole degrees."""
    return F.round(F.atan(slope * (epochs - 1)) * 180 / HALF_TURN).cast("int")


def minigraph(values: Column, buckets: int = 8) -> Column:
    """``buckets`` nibbles, the first lowest: min(floor(6 v), 15) of the series resampled."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.get(values, F.floor(i * F.size(values) / buckets).cast("int")))
    quantised = F.transform(picked, lambda v: F.least(F.floor(F.round(v, 9) * 6), F.lit(15)).cast("bigint"))
    places = F.array(*[F.lit(16**i).cast("bigint") for i in range(buckets)])
    return F.aggregate(F.zip_with(quantised, places, lambda q, p: q * p), F.lit(0).cast("bigint"), lambda s, x: s + x)


def parse_window(explicit: int | None, path: str, fallback: int) -> int:
    """A window's width: as given, else from the first part ``w<n>``, 0 < n < 100, of a model's path, split at dots."""
    if explicit is not None:
        return explicit
    for part in path.split("."):
        if part[:1] == "w" and part[1:].isdigit() and 0 < int(part[1:]) < 100:
            return int(part[1:])
    return fallback


def normal_p(z: float) -> float:
    """Two-sided p-value of a standard normal score."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: int) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta's continued fraction."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x = df / (df + t * t)
    return _beta_inc(df / 2, 0.5, x)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            k = 1.0
        elif i % 2 == 0:
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + k * d, 1e-300) if 1 + k * d > 0 else 1 / min(1 + k * d, -1e-300)
        c = 1 + k / c
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1) / a
