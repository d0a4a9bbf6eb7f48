"""Closed-form checks of a fitted count model. ``rows`` come from ``effects.with_fit``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.functions.special import log_gamma

LARGE_RESIDUAL = 3.0


def pearson(y: str = "birds") -> Column:
    return (F.col(y) - F.col("mean")) / F.sqrt("variance")


def dispersion(rows: DataFrame, by: str = "species", y: str = "birds") -> DataFrame:
    """Pearson chi-square over residual degrees of freedom; about 1 for a model that fits."""
    sums = rows.groupBy(by).agg(
        F.sum(pearson(y) * pearson(y)).alias("chi2"), F.count("*").alias("n"), F.max("k").alias("k")
    )
    return sums.select(by, "chi2", ratio(F.col("chi2"), F.col("n") - F.col("k")).alias("dispersion"))


def zero_ratio(rows: DataFrame, by: str = "species", y: str = "birds") -> DataFrame:
    """Observed zeros over expected zeros."""
    sums = rows.groupBy(by).agg(
        F.sum((F.col(y) == 0).cast("int")).alias("observed"), F.sum("p_zero").alias("expected")
    )
    return sums.withColumn("zero_ratio", ratio(F.col("observed"), F.col("expected")))


def durbin_watson(rows: DataFrame, by: str = "species", period: str = "year", y: str = "birds") -> DataFrame:
    """Lag-1 autocorrelation statistic of residuals averaged per period.

    The window is over periods of a group, after the averaging.
    """
    yearly = rows.groupBy(by, period).agg(F.avg(pearson(y)).alias("e"))
    before = F.lag("e").over(Window.partitionBy(by).orderBy(period))
    steps = yearly.withColumn("step", F.col("e") - before)
    sums = steps.groupBy(by).agg(F.sum(F.col("step") * F.col("step")).alias("top"), F.sum(F.col("e") * F.col("e")).alias("bottom"))
    return sums.select(by, ratio(F.col("top"), F.col("bottom")).alias("durbin_watson"))


def outlier_share(rows: DataFrame, by: str = "species", y: str = "birds", cut: float = LARGE_RESIDUAL) -> DataFrame:
    big = (F.abs(pearson(y)) > cut).cast("double")
    return rows.groupBy(by).agg(F.sum(big).cast("bigint").alias("outliers"), F.avg(big).alias("outlier_share"))


def log_likelihood(rows: DataFrame, by: str = "species", y: str = "birds") -> DataFrame:
    """Summed log-likelihood of the rows under their model."""
    count, mu, theta, pi = F.col(y), F.col("mu"), F.col("theta"), F.col("pi")
    poisson = count * F.log(mu) - mu - log_gamma(count + 1.0)
    negbin = (
        log_gamma(count + theta) - log_gamma(theta) - log_gamma(count + 1.0)
        + theta * (F.log(theta) - F.log(theta + mu)) + count * (F.log(mu) - F.log(theta + mu))
    )
    plain = F.when(F.col("family") == "poisson", poisson).otherwise(negbin)
    l = F.when(pi == 0, plain).when(count == 0, F.log("p_zero")).otherwise(F.log(1 - pi) + plain)
    return rows.groupBy(by).agg(F.sum(l).alias("loglik"), F.count("*").alias("n"), F.max("k").alias("k"))


def diagnostics(rows: DataFrame, by: str = "species", period: str = "year", y: str = "birds", cut: float = LARGE_RESIDUAL) -> DataFrame:
    """All checks side by side, one row per group, from a single pass over the rows.

    Rows are reduced to periods of a group; every figure is a sum over those.
    """
    e = F.col("e")
    parts = rows.withColumn("e", pearson(y)).groupBy(by, period).agg(
        F.count("*").alias("n"), F.max("k").alias("k"), F.sum(e * e).alias("chi2"), F.avg(e).alias("mean_e"),
        F.sum((F.col(y) == 0).cast("int")).alias("observed"), F.sum("p_zero").alias("expected"),
        F.sum((F.abs(e) > cut).cast("int")).alias("big"),
    )
    step = F.col("mean_e") - F.lag("mean_e").over(Window.partitionBy(by).orderBy(period))
    return parts.withColumn("step", step).groupBy(by).agg(
        ratio(F.sum("chi2"), F.sum("n") - F.max("k")).alias("dispersion"),
        ratio(F.sum("observed"), F.sum("expected")).alias("zero_ratio"),
        ratio(F.sum(F.col("step") * F.col("step")), F.sum(F.col("mean_e") * F.col("mean_e"))).alias("durbin_watson"),
        F.sum("big").alias("outliers"), ratio(F.sum("big"), F.sum("n")).alias("outlier_share"),
    )


def null_model(frame: DataFrame, by: str = "species", y: str = "birds") -> DataFrame:
    """Intercept-only Poisson model, in closed form."""
    count = F.col(y)
    sums = frame.groupBy(by).agg(
        F.avg(count).alias("mean"), F.sum(count).alias("total"), F.count("*").alias("n"),
        F.sum(log_gamma(count + 1.0)).alias("constant"),
    ).filter("total > 0")
    log_mean = F.log("mean")
    return sums.select(
        by, "n", log_mean.alias("intercept"), (1 / F.sqrt("total")).alias("se"),
        (F.col("total") * log_mean - F.col("total") - F.col("constant")).alias("loglik"),
    )
