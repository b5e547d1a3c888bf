"""Upper tail probabilities of the test statistics as plain column expressions.

Where a tail is a finite sum (chi-square; F with one or an even number of numerator degrees) it is
that sum. The normal and Student tails are ratios of integrals, by Simpson's rule over a sequence.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2000


def _simpson(f: Callable[[Column], Column], lo: Column, hi: Column) -> Column:
    """Integral of ``f`` from ``lo`` to ``hi`` over an even number of equal steps."""
    step = (hi - lo) / _STEPS
    at = F.transform(F.sequence(F.lit(0), F.lit(_STEPS)), lambda i: F.struct(i.alias("i"), (lo + i * step).alias("x")))
    total = F.aggregate(at, F.lit(0.0), lambda s, p: s + f(p["x"]) * F.when((p["i"] == 0) | (p["i"] == _STEPS), 1.0).when(p["i"] % 2 == 1, 4.0).otherwise(2.0))
    return total * step / 3


def norm_sf(z: Column) -> Column:
    """P(Z > z): the density from |z| on; its part beyond 12 more deviations is below double precision."""
    upper = _simpson(lambda x: F.exp(-x * x / 2), F.abs(z), F.abs(z) + 12) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t, with t = sqrt(df) tan(a): the integral of cos(a)^(df - 1) from there on over the whole.

    Above 200 degrees the statistic goes through Hill's normalising expansion (error below 1e-8).
    """
    density = lambda a: F.pow(F.greatest(F.cos(a), F.lit(0.0)), F.greatest(df, F.lit(1.0)) - 1)
    upper = _simpson(density, F.atan(F.abs(t) / F.sqrt(df)), F.lit(math.pi / 2)) / (2 * _simpson(density, F.lit(0.0), F.lit(math.pi / 2)))
    a = df - 0.5
    z = F.sqrt(a * F.log1p(t * t / df))
    b = 48 * a * a
    normal = norm_sf(z + (F.pow(z, 3) + 3 * z) / b - (4 * F.pow(z, 7) + 33 * F.pow(z, 5) + 240 * F.pow(z, 3) + 855 * z) / (10 * b * (b + 0.8 * F.pow(z, 4) + 100)))
    tail = F.when(df > 200, normal).otherwise(upper)
    return F.when(t >= 0, tail).otherwise(1 - tail)


def chi2_sf(h: Column, df: Column) -> Column:
    """P(X > h) of chi-square with whole ``df``: two degrees at a time from e^(-h/2) (even) or the normal tail (odd)."""
    odd = df % 2
    first = F.when(odd == 1, 2 * norm_sf(F.sqrt(h))).otherwise(F.lit(0.0))
    # term of k degrees: (h/2)^(k/2) e^(-h/2) / Gamma(k/2 + 1), each from the one before
    term = F.when(odd == 1, F.sqrt(2 * h / math.pi)).otherwise(F.lit(1.0)) * F.exp(-h / 2)
    steps = F.filter(F.sequence(F.lit(0), F.floor((df - odd) / 2).cast("int")), lambda i: i > 0)
    start = F.struct(first.alias("sum"), term.alias("term"), odd.cast("double").alias("k"))
    return F.aggregate(steps, start, lambda s, i: F.struct(
        (s["sum"] + s["term"]).alias("sum"), (s["term"] * h / (s["k"] + 2)).alias("term"), (s["k"] + 2).alias("k")), lambda s: s["sum"])


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f): Student's tail for d1 = 1, a finite sum for even d1; null for other odd d1."""
    x = d2 / (d2 + d1 * f)
    steps = F.filter(F.sequence(F.lit(0), F.floor(d1 / 2).cast("int")), lambda i: i > 0)
    start = F.struct(F.lit(0.0).alias("sum"), F.pow(x, d2 / 2).alias("term"))
    even = F.aggregate(steps, start, lambda s, i: F.struct(
        (s["sum"] + s["term"]).alias("sum"), (s["term"] * (d2 / 2 + i - 1) / i * (1 - x)).alias("term")), lambda s: s["sum"])
    return F.when(d1 == 1, 2 * t_sf(F.sqrt(f), d2.cast("double"))).when(d1 % 2 == 0, even)
