"""Effort, totals, rates and detections.

Effort is stored on every species row of a day, so each effort figure first reduces the panel to
distinct days; the reduction happens before the shuffle, in every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio


def day_effort(panel: DataFrame, *keys: str) -> DataFrame:
    return panel.select(*keys, "date", "obs_hours").distinct()


def survey_days(panel: DataFrame) -> DataFrame:
    return panel.agg(F.countDistinct("date").alias("survey_days"))


def days_per_year(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year").agg(F.countDistinct("date").alias("days"))


def days_per_year_stats(panel: DataFrame) -> DataFrame:
    return days_per_year(panel).agg(F.avg("days").alias("mean_days"), F.stddev_samp("days").alias("sd_days"))


def total_effort(panel: DataFrame) -> DataFrame:
    return day_effort(panel).agg(F.sum("obs_hours").alias("total_hours"))


def repeated_effort(panel: DataFrame) -> DataFrame:
    """Hours summed over species rows, as an earlier report did; kept to reproduce it."""
    return panel.agg(F.sum("obs_hours").alias("row_hours"))


def effort_by_year(panel: DataFrame) -> DataFrame:
    return day_effort(panel, "year").groupBy("year").agg(F.sum("obs_hours").alias("total_effort"))


def mean_effort_per_year(panel: DataFrame) -> DataFrame:
    return effort_by_year(panel).agg(F.avg("total_effort").alias("mean_effort"))


def mean_daily_effort(panel: DataFrame) -> DataFrame:
    return day_effort(panel, "year").groupBy("year").agg(F.avg("obs_hours").alias("mean_daily_effort"))


def mean_of_yearly_means(panel: DataFrame) -> DataFrame:
    return mean_daily_effort(panel).agg(F.avg("mean_daily_effort").alias("mean_of_means"))


def total_birds(panel: DataFrame) -> DataFrame:
    return panel.agg(F.sum("birds").alias("birds"))


def totals(panel: DataFrame, *keys: str, name: str = "total_birds") -> DataFrame:
    return panel.groupBy(*keys).agg(F.sum("birds").alias(name))


def rate_by_year(panel: DataFrame) -> DataFrame:
    """Birds per hour by year, each day's effort taken once.

    Days are the finer grain of both figures: one scan reduces the panel to a row per day and effort,
    and from those rows birds and hours are added up together, with nothing to join.
    """
    by_day = panel.groupBy("year", "date", "obs_hours").agg(F.sum("birds").alias("birds"))
    both = by_day.groupBy("year").agg(F.sum("birds").alias("total_birds"), F.sum("obs_hours").alias("total_effort"))
    return both.withColumn("birds_per_hour", ratio(F.col("total_birds"), F.col("total_effort")))


def rate_by(panel: DataFrame, *keys: str) -> DataFrame:
    """Birds per hour with effort summed over species rows, as an earlier report did."""
    both = panel.groupBy(*keys).agg(
        F.sum("obs_hours").alias("total_effort"), F.sum("birds").alias("total_birds")
    )
    return both.withColumn("birds_per_hour", ratio(F.col("total_birds"), F.col("total_effort")))


def rate_at_effort(panel: DataFrame, hours: float, *keys: str) -> DataFrame:
    """Birds per hour against one effort figure for all groups."""
    summed = totals(panel, *keys).withColumn("total_effort", F.lit(float(hours)))
    return summed.withColumn("birds_per_hour", ratio(F.col("total_birds"), F.col("total_effort")))


def daily_rate(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Birds per hour of each day; days without effort are left out before the sum."""
    summed = panel.filter("obs_hours != 0").groupBy(*keys).agg(F.sum("birds").alias("total_birds"))
    return summed.withColumn("birds_per_hour", ratio(F.col("total_birds"), F.col("obs_hours")))


def days_by_category(panel: DataFrame, category: str) -> DataFrame:
    seen = panel.filter(F.col(category).isNotNull()).select("date", category).distinct()
    return seen.groupBy(category).agg(F.count("*").alias("n"))


def periods_detected(panel: DataFrame, period: str, name: str) -> DataFrame:
    """Number of periods with at least one bird, by species."""
    per_period = panel.groupBy("species", period).agg(F.sum("birds").alias("birds")).filter("birds > 0")
    return per_period.groupBy("species").agg(F.count("*").alias(name))


def detection_days(panel: DataFrame) -> DataFrame:
    return periods_detected(panel, "date", "detection_days")


def years_detected(panel: DataFrame, period: str = "year") -> DataFrame:
    return periods_detected(panel, period, "years_detected")


def seen_every_period(panel: DataFrame, period: str = "year") -> DataFrame:
    """Species detected in every period the panel covers; the cover is one number, joined as such."""
    cover = panel.agg(F.countDistinct(period).alias("periods"))
    found = years_detected(panel, period)
    return found.join(cover, found["years_detected"] == cover["periods"]).select("species", "years_detected")


def species_by_year(panel: DataFrame, years: Sequence[int]) -> DataFrame:
    """Counts by species and year, a column per year; years are given so that no extra job finds them."""
    return panel.groupBy("species").pivot("year", list(years)).agg(F.sum("birds"))


def ranked(df: DataFrame, value: str, *tie: str) -> DataFrame:
    return df.orderBy(F.desc(value), *tie)


def top(df: DataFrame, k: int, value: str, *tie: str) -> DataFrame:
    """The k largest, as a distributed top-k rather than a full sort."""
    return ranked(df, value, *tie).limit(k)


def positions(df: DataFrame, value: str, *tie: str, name: str = "position") -> DataFrame:
    """Rank of each row. The window is global: use it on rows already reduced to groups."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(value), *tie)))


def rate_histogram(df: DataFrame, value: Column, width: float) -> DataFrame:
    """Counts per bin of equal width."""
    return df.select(F.floor(value / F.lit(width)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
