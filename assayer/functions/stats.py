"""Statistics of proportions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % quantile of the normal distribution.
Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval for k of n, clamped to [0, 1]; null if n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k.cast("double") / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = lambda c: F.when(n.isNotNull(), c)  # greatest and least would skip a null
    return some(F.greatest(centre - half, F.lit(0.0))), some(F.least(centre + half, F.lit(1.0)))


def rate(k: Column, n: Column, digits: int = 4) -> Column:
    """struct(rate, n, ci95), rounded; rate and ci95 are null if n is 0."""
    lo, hi = wilson(k, n)
    value = F.round(k.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)), digits)
    ends = F.when(n > 0, F.array(F.round(lo, digits), F.round(hi, digits)))
    return F.struct(value.alias("rate"), n.cast("long").alias("n"), ends.alias("ci95"))


def three_way(grade: Column, among: Column) -> tuple[Column, Column, Column, Column]:
    """Counts (aggregates) of a three-valued grade: rows, correct, wrong, abstained."""
    has = among & grade.isNotNull()
    one = lambda v: F.count_if(has & (grade == v))
    return F.count_if(has), one("correct"), one("wrong"), one("abstained")


def compare(got: Column, want: Column) -> Column:
    """Three-valued grade: a null answer abstains; it never equals wrong."""
    return F.when(got.isNull(), "abstained").when(got == want, "correct").otherwise("wrong")


#: ln z! minus Stirling's formula for z from 0 to 15; beyond, a series is exact to the last digit.
_STIRLING_TABLE = [0.0, *(math.lgamma(z + 1) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi) for z in range(1, 16))]


def _stirling_error(z: Column) -> Column:
    r = 1 / (z * z)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - r / 1188) * r) * r) * r) / z
    return F.when(z < 16, F.get(F.array(*[F.lit(v) for v in _STIRLING_TABLE]), z.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without the digits that cancel."""
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def binomial_half(n: Column, k: Column) -> Column:
    """Probability of k heads in n tosses, by the saddle-point expansion: no large logarithms are subtracted."""
    n, k = n.cast("double"), k.cast("double")
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n / 2) - _deviance(n - k, n / 2)
    return F.when(k == 0, F.pow(F.lit(0.5), n)).otherwise(F.exp(log) * F.sqrt(n / (2 * math.pi * k * (n - k))))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 without any.

    The tail of k = min(b, c) heads in n = b + c tosses is its largest term, C(n, k) / 2^n, times a sum
    whose terms follow from one another by (k - i) / (n - k + 1 + i).  Beyond 4.5 times the root of n
    they add nothing to a double, so a row costs the root of its counts at most, whatever they are.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    terms = F.least(k, F.ceil(F.sqrt(n.cast("double")) * 4.5).cast("long") + 8).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    ratio = lambda i: (k - i).cast("double") / (n - k + 1 + i).cast("double")

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * ratio(i)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    tail = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), terms - 1), start, step, lambda a: a["s"])).otherwise(1.0)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_half(n, k) * tail))
