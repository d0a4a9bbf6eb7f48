"""Station readings, daily weather and its join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.operators import wind
from tallywing.operators.panel import attach_days
from tallywing.plans.catalog import query
from tallywing.sources.weather import normalise_station, typed_station

_PART = "strftime(datetime, '%H:%M:%S') >= '03:00:00' AND strftime(datetime, '%H:%M:%S') < '19:15:00'"
_DAILY = f"""
    SELECT date, (degrees(atan2(avg(wind_speed * sin(radians(wind_direction))), avg(wind_speed * cos(radians(wind_direction))))) + 360) % 360
             AS wind_dir, avg(wind_speed) AS wind_speed, avg(pressure) AS pressure
    FROM wx WHERE {_PART} AND date IN (SELECT date FROM wx_dates) GROUP BY date"""
_ROUNDED = "round(wind_dir, 6) AS wind_dir, round(wind_speed, 6) AS wind_speed, round(pressure, 6) AS pressure"


def _r6(df):
    return df.withColumns({c: F.round(c, 6) for c in ("wind_dir", "wind_speed", "pressure")})


@query("wx_normalise", """
    SELECT date_trunc('second', ts) - INTERVAL 5 HOUR AS datetime, CAST(date_trunc('second', ts) - INTERVAL 5 HOUR AS DATE) AS date,
           value AS wind_speed, CAST(event_id * 37 % 360 AS DOUBLE) AS wind_direction,
           round_even(1000 + (user_id % 30) / 16.0::DOUBLE, 3) AS pressure
    FROM events""", dates=("datetime", "date"))
def wx_normalise(t):
    """A station export as typed by the sensors: suffixed names, a units row, UTC text."""
    readings = t.base("events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date_Time"),
        F.col("value").cast("string").alias("wind_speed_set_1"),
        (F.col("event_id") * 37 % 360).cast("string").alias("wind_direction_set_1"),
        (1000 + F.col("user_id") % 30 / F.lit(16.0)).cast("string").alias("pressure_set_1d"),
        F.lit("1013").alias("altimeter_set_1"),
    )
    units = t.spark.range(1).select(
        F.lit("").alias("Date_Time"), F.lit("m/s").alias("wind_speed_set_1"), F.lit("Degrees").alias("wind_direction_set_1"),
        F.lit("Pascals").alias("pressure_set_1d"), F.lit("Pascals").alias("altimeter_set_1"),
    )
    return typed_station(normalise_station(readings.unionByName(units)), "America/New_York")


@query("wx_daypart", f"SELECT date, count(*) AS n, round(sum(wind_speed), 4) AS run FROM wx WHERE {_PART} GROUP BY date", ("wx",), dates=("date",))
def wx_daypart(t):
    return wind.day_part(t.wx).groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum("wind_speed"), 4).alias("run"))


@query("wind_vector_mean", """
    SELECT date, round((degrees(atan2(avg(wind_speed * sin(radians(wind_direction))), avg(wind_speed * cos(radians(wind_direction))))) + 360)
           % 360, 6) AS wind_dir
    FROM wx GROUP BY date""", ("wx",), dates=("date",))
def wind_vector_mean(t):
    return _r6(wind.daily_weather(t.wx)).select("date", "wind_dir")


@query("wx_daily", f"SELECT date, {_ROUNDED} FROM ({_DAILY})", ("wx", "wx_dates"), dates=("date",))
def wx_daily(t):
    return _r6(wind.weather_on(t.wx, t.wx_dates))


@query("join_weather", f"""
    SELECT d.date, d.birds, {_ROUNDED} FROM wx_dates d LEFT JOIN ({_DAILY}) USING (date)""", ("wx", "wx_dates"), dates=("date",))
def join_weather(t):
    return _r6(attach_days(t.wx_dates, wind.weather_on(t.wx, t.wx_dates))).select(
        "date", "birds", "wind_dir", "wind_speed", "pressure"
    )


@query("wind_covariates", """
    SELECT date, CAST(dayofyear(date) AS INTEGER) AS doy, round(cos(wind_dir), 6) AS wind_dir_cos, round(sin(wind_dir), 6) AS wind_dir_sin,
           round(cos(radians(wind_dir)), 6) AS degrees_cos, round(sin(radians(wind_dir)), 6) AS degrees_sin
    FROM days""", ("days",), dates=("date",))
def wind_covariates(t):
    """Both readings of the wind angle: as the published models took it, and as degrees."""
    from tallywing.operators.panel import covariates

    as_is = covariates(t.days.select("date", "wind_dir"))
    both = covariates(as_is.withColumnsRenamed({"wind_dir_cos": "c", "wind_dir_sin": "s"}), unit="degrees")
    return both.select(
        "date", "doy", F.round("c", 6).alias("wind_dir_cos"), F.round("s", 6).alias("wind_dir_sin"),
        F.round("wind_dir_cos", 6).alias("degrees_cos"), F.round("wind_dir_sin", 6).alias("degrees_sin"),
    )
