"""Special functions the SQL dialect lacks, written as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_SHIFT = 8


def _series(inverse: Column, powers: list[tuple[int, float]]) -> Column:
    total = F.lit(0.0)
    for power, weight in powers:
        term = F.lit(weight)
        for _ in range(power):
            term = term * inverse
        total = total + term
    return total


def log_gamma(x: Column) -> Column:
    """log Γ(x) for x > 0: Stirling's series at x + 8, taken back by the recurrence."""
    z = x + F.lit(float(_SHIFT))
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + F.lit(float(k)))
    inverse = F.lit(1.0) / z
    tail = _series(inverse, [(1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)])
    return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + tail - F.log(product)


def digamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    inverse = F.lit(1.0) / z
    back = F.lit(0.0)
    for k in range(_SHIFT):
        back = back + F.lit(1.0) / (x + F.lit(float(k)))
    tail = _series(inverse, [(1, -1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -1 / 132)])
    return F.log(z) + tail - back


def trigamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    inverse = F.lit(1.0) / z
    back = F.lit(0.0)
    for k in range(_SHIFT):
        step = x + F.lit(float(k))
        back = back + F.lit(1.0) / (step * step)
    tail = _series(inverse, [(1, 1.0), (2, 1 / 2), (3, 1 / 6), (5, -1 / 30), (7, 1 / 42), (9, -1 / 30)])
    return tail + back


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|). Used on coefficient tables, a handful of rows per group."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0))).astype("float64")


#: Beta tails: the integral stops where the integrand has fallen by exp(-DROP); panels of so many nodes cover what is left.
_DROP, _PANELS, _NODES, _NEWTON = 45.0, 12, 16, 40


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _log_beta(a: Column, b: Column) -> Column:
    """log B(a, b), to full precision for large arguments too: log Γ of the sum less that of the larger, by Stirling's series, has
    no large parts that cancel."""
    large, small = F.greatest(a, b), F.least(a, b)
    z = large + F.lit(float(_SHIFT))
    tail = [(1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188)]
    rise = (z - 0.5) * F.log1p(small / z) + small * F.log(z + small) - small
    rise = rise + _series(1.0 / (z + small), tail) - _series(1.0 / z, tail)
    for k in range(_SHIFT):
        rise = rise - F.log1p(small / (large + F.lit(float(k))))
    return log_gamma(small) - rise


def _log_density(a: Column, b: Column, y: Column) -> Column:
    """log of s^a (1 - s)^b for s = 1 / (1 + exp(-y)), whatever the size of y."""
    low = F.log1p(F.exp(-F.abs(y)))
    return a * (F.least(y, F.lit(0.0)) - low) + b * (F.least(-y, F.lit(0.0)) - low)


def _lower_tail(a: Column, b: Column, y: Column) -> Column:
    """Integral of the beta density in log odds up to ``y``, which is at its mode or below.

    There the density rises towards ``y`` and its log is concave: Newton steps from beyond find where it has fallen far enough, and
    Gauss-Legendre panels cover the rest. The work is the same for all arguments.
    """
    def begun(v: Column) -> Column:
        top = _log_density(v["a"], v["b"], v["y"])
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), v["y"].alias("y"), top.alias("top"), ((_DROP + v["a"] * v["y"] - top) / v["a"]).alias("s"))

    def nearer(v: Column, _: Column) -> Column:
        at = v["y"] - v["s"]
        fall = v["top"] - _log_density(v["a"], v["b"], at)
        steep = v["a"] - (v["a"] + v["b"]) / (1 + F.exp(-at))
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), v["y"].alias("y"), v["top"].alias("top"), (v["s"] - (fall - _DROP) / steep).alias("s"))

    def added(v: Column, node: Column) -> Column:
        value = F.exp(_log_density(v["a"], v["b"], v["y"] - v["s"] * node["x"]) - v["top"])
        return F.struct(v["a"].alias("a"), v["b"].alias("b"), v["y"].alias("y"), v["top"].alias("top"), v["s"].alias("s"),
                        (v["total"] + node["w"] * value).alias("total"))

    def finished(v: Column) -> Column:
        return v["total"] * v["s"] * F.exp(v["top"] - _log_beta(v["a"], v["b"]))

    places, weights = np.polynomial.legendre.leggauss(_NODES)
    nodes = F.array(*[F.struct(F.lit((k + (x + 1) / 2) / _PANELS).alias("x"), F.lit(w / 2 / _PANELS).alias("w"))
                      for k in range(_PANELS) for x, w in zip(places.tolist(), weights.tolist())])
    first = _let(F.struct(a.alias("a"), b.alias("b"), y.alias("y")), begun)
    reach = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), first, nearer)
    start = _let(reach, lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), v["y"].alias("y"), v["top"].alias("top"), v["s"].alias("s"), F.lit(0.0).alias("total")))
    return F.aggregate(nodes, start, added, finished)


def beta_cdf_of_log_odds(a: Column, b: Column, y: Column) -> Column:
    """Regularised incomplete beta function at x = 1 / (1 + exp(-y)), so that neither x nor 1 - x loses digits.

    NULL unless both parameters are positive and ``y`` is known. Good to 1e-10 while the smaller parameter is below a hundred thousand, to
    some 1e-9 where both are in the millions, whose logs cancel.
    """
    below = y <= F.log(a / b)
    tail = _lower_tail(F.when(below, a).otherwise(b), F.when(below, b).otherwise(a), F.when(below, y).otherwise(-y))
    return F.when((a > 0) & (b > 0) & y.isNotNull() & ~F.isnan(y), F.when(below, tail).otherwise(1 - tail))


def student_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|), for any number of degrees of freedom."""
    nu, square = df.cast("double"), t * t
    value = beta_cdf_of_log_odds(nu / 2, F.lit(0.5), F.log(nu / F.when(square > 0, square)))
    return F.when(nu > 0, F.when(square == 0, F.lit(1.0)).when(square == float("inf"), F.lit(0.0)).otherwise(value))


def f_upper_p(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) with ``df1`` and ``df2`` degrees of freedom."""
    a, b = df2.cast("double") / 2, df1.cast("double") / 2
    value = beta_cdf_of_log_odds(a, b, F.log(df2 / (df1 * F.when(f > 0, f))))
    return F.when((df1 > 0) & (df2 > 0), F.when(f <= 0, F.lit(1.0)).when(f == float("inf"), F.lit(0.0)).otherwise(value))
