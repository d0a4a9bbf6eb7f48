"""Daily weather from station readings, all days in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.dates import time_text

# The part of the day birds are counted in, first included, last excluded.
DAY_START = "03:00:00"
DAY_END = "19:15:00"


def day_part(readings: DataFrame, start: str = DAY_START, end: str = DAY_END) -> DataFrame:
    clock = time_text(F.col("datetime"))
    return readings.filter((clock >= start) & (clock < end))


def daily_weather(readings: DataFrame) -> DataFrame:
    """Speed-weighted mean wind direction, mean speed and mean pressure by date.

    Each reading is a vector east and north; the means are recombined into an angle in [0, 360).
    """
    angle = F.radians("wind_direction")
    means = readings.groupBy("date").agg(
        F.avg(F.col("wind_speed") * F.sin(angle)).alias("east"),
        F.avg(F.col("wind_speed") * F.cos(angle)).alias("north"),
        F.avg("wind_speed").alias("wind_speed"),
        F.avg("pressure").alias("pressure"),
    )
    direction = F.pmod(F.degrees(F.atan2("east", "north")) + 360.0, F.lit(360.0))
    return means.select("date", direction.alias("wind_dir"), "wind_speed", "pressure")


def weather_on(readings: DataFrame, dates: DataFrame) -> DataFrame:
    """Daily weather of the survey dates, counting hours only."""
    wanted = day_part(readings).join(F.broadcast(dates.select("date").distinct()), "date", "left_semi")
    return daily_weather(wanted)
