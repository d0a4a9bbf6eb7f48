"""Tails of the beta, t and F distributions, and the pooled timing line on unbalanced panels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.functions.special import beta_cdf_of_log_odds, f_upper_p, student_two_sided_p
from tallywing.operators import timing


def binomial_sum(a, b, x):
    """I_x(a, b) for whole a and b, a sum of binomial terms."""
    n = a + b - 1
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a, n + 1))


def student_series(t, df):
    """The finite trigonometric series."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c, total, term = math.cos(theta), 0.0, 1.0
    if df % 2:
        term = c
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 1 - 2 / math.pi * (theta + (math.sin(theta) * total if df > 1 else 0))
    for k in range(1, df // 2 + 1):
        total += term
        term *= c * c * (2 * k - 1) / (2 * k)
    return 1 - math.sin(theta) * total


def test_beta_against_sums(spark):
    rows = [(float(a), float(b), x, binomial_sum(a, b, x)) for a in (1, 2, 7, 60) for b in (1, 3, 40) for x in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.999)]
    df = spark.createDataFrame(rows, "a double, b double, x double, want double")
    for r in df.withColumn("got", beta_cdf_of_log_odds(F.col("a"), F.col("b"), F.log(F.col("x") / (1 - F.col("x"))))).collect():
        assert r.got == pytest.approx(r.want, rel=1e-9, abs=1e-13), r


def test_student_of_few_and_ten_million(spark):
    rows = [(t, df, student_series(t, df)) for df in (1, 2, 3, 10, 125, 1000) for t in (0.0, 0.001, 0.5, -1.0, 2.0, 4.0, 9.0)]
    for df in (100_000, 10_000_000):
        for t in (0.3, 1.0, 1.96, 5.0):  # normal tail and its first two corrections
            phi = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            first, second = (t**3 + t) / 4, (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / 96
            rows.append((t, df, math.erfc(t / math.sqrt(2)) + 2 * phi * (first / df + second / df**2)))
    frame = spark.createDataFrame(rows, "t double, df long, want double")
    for r in frame.withColumn("got", student_two_sided_p(F.col("t"), F.col("df"))).collect():
        assert r.got == pytest.approx(r.want, rel=1e-9, abs=1e-12), r


def test_f_is_t_squared_and_edges(spark, one):
    for t, df in ((0.7, 9), (2.5, 3_000_000)):
        assert one(f_upper_p(F.lit(t * t), F.lit(1), F.lit(df))) == pytest.approx(one(student_two_sided_p(F.lit(t), F.lit(df))), rel=1e-10)
    assert one(f_upper_p(F.lit(1.0), F.lit(5_000_000), F.lit(5_000_000))) == pytest.approx(0.5, abs=3e-9)  # logs of millions cancel here
    assert one(f_upper_p(F.lit(0.0), F.lit(2), F.lit(2))) == 1.0 and one(f_upper_p(F.lit(None).cast("double"), F.lit(2), F.lit(2))) is None
    assert one(student_two_sided_p(F.lit(2.0), F.lit(0))) is None and one(student_two_sided_p(F.lit(float("inf")), F.lit(3))) == 0.0
    assert one(student_two_sided_p(F.lit(None).cast("double"), F.lit(3))) is None


def dense_line(days, log_ratio):
    """Profile likelihood of a line with a random level per species, from whole matrices."""
    species = sorted({s for s, _, _ in days})
    z = np.array([[s == k for k in species] for s, _, _ in days], float)
    x, y = np.column_stack([np.ones(len(days)), [t for _, t, _ in days]]), np.array([m for _, _, m in days])
    v = np.eye(len(days)) + math.exp(log_ratio) * z @ z.T
    inverse = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ inverse @ x)
    beta = cov @ x.T @ inverse @ y
    r = y - x @ beta
    sigma2 = r @ inverse @ r / len(days)
    value = -(len(days) * math.log(sigma2) + np.linalg.slogdet(v)[1]) / 2
    return value, beta, sigma2, cov


@pytest.mark.parametrize("spread", [0.0, 8.0])
def test_pooled_line_on_an_unbalanced_panel(spark, spread):
    rng = np.random.default_rng(4)
    days = [(f"s{k}", int(2010 + t), float(200 + level + 0.8 * t + rng.normal(0, 3))) for k, level in enumerate(rng.normal(0, spread, 9)) for t in range(9)
            if rng.random() < 0.6 or t == k] + [("once", 2018, 230.0)]
    centred = [(s, t - 2014, m) for s, t, m in days]
    values = [(dense_line(centred, g)[0], g) for g in np.linspace(-12, 8, 2001)]
    best = max(values)[1]
    for step in (0.005, 0.0005, 0.00005):
        best = max((dense_line(centred, best + step * k)[0], best + step * k) for k in range(-4, 5))[1]
    _, beta, sigma2, cov = dense_line(centred, best)
    frame = spark.createDataFrame(days, "species string, year int, mean_doy double")
    trends = timing.species_trends(frame)
    got = timing.pooled_trend(trends).first()
    assert got["n"] == len(days) and got["slope"] == pytest.approx(beta[1], abs=1e-3)
    assert got["sigma2"] == pytest.approx(sigma2, rel=1e-3) and got["se"] == pytest.approx(math.sqrt(sigma2 * cov[1, 1]), rel=1e-3)
    assert got["levels"] == pytest.approx(math.exp(best) * sigma2, rel=1e-2, abs=1e-3)
    for r in timing.predict_all(frame, trends).collect():
        x = np.array([1.0, r["year"] - 2014])
        assert r["predicted"] == pytest.approx(x @ beta, abs=5e-3)
        assert r["conf_high"] - r["predicted"] == pytest.approx(1.96 * math.sqrt(sigma2 * x @ cov @ x), rel=5e-3)
