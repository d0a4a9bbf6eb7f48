"""Weather station files: a units row under the header, suffixed names, UTC times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.functions.dates import local_wall_time
from tallywing.functions.numbers import parse_number

# Sensor suffixes of the station export, and the text that marks its units row.
SUFFIXES = ("_set_1d", "_set_1")
UNITS_COLUMN = "altimeter_set_1"
UNITS_TEXT = "Pascals"


def plain_name(name: str) -> str:
    """``Wind_Speed_set_1`` to ``wind_speed``."""
    for suffix in SUFFIXES:
        name = name.replace(suffix, "", 1)
    return name.lower()


def normalise_station(raw: DataFrame, units_column: str = UNITS_COLUMN, units_text: str = UNITS_TEXT) -> DataFrame:
    """Drop the units row and give every column its plain name, in one projection. A reading whose cell in that column
    is blank or NULL is no units row and stays."""
    readings = raw.filter(~F.col(units_column).eqNullSafe(units_text))
    return readings.select(*[F.col(f"`{c}`").alias(plain_name(c)) for c in raw.columns])


def typed_station(plain: DataFrame, zone: str) -> DataFrame:
    """Text readings to ``(datetime, date, wind_speed, wind_direction, pressure)`` in local time."""
    local = local_wall_time(F.col("date_time"), zone)
    return plain.select(
        local.alias("datetime"),
        local.cast("date").alias("date"),
        parse_number(F.col("wind_speed")).alias("wind_speed"),
        parse_number(F.col("wind_direction")).alias("wind_direction"),
        F.bround(parse_number(F.col("pressure")), 3).alias("pressure"),
    )


def read_station(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    return typed_station(normalise_station(raw), zone)
