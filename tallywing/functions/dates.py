"""Dates, clocks and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_us_date(text: Column) -> Column:
    """Month-day-year text with ``/``, ``-`` or ``.`` between and a 2- or 4-digit year, else NULL.

    Two-digit years from 69 on belong to the last century.
    """
    plain = F.translate(F.trim(text), "/.", "--")
    short = F.when(plain.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.try_to_timestamp(plain, F.lit("M-d-yy")))
    full = F.when(plain.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_timestamp(plain, F.lit("M-d-yyyy")))
    short = short.cast("date")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(short, full.cast("date"))


def day_label(day_of_year: Column) -> Column:
    """Axis label such as ``Oct-01``, counted from the start of the leap year 2020."""
    return F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), day_of_year.cast("int")), "MMM-dd")


def season_date(date: Column) -> Column:
    """The same month and day in the year 2000, so that seasons overlay."""
    return F.make_date(F.lit(2000), F.month(date), F.dayofmonth(date))


def clock_hours(text: Column) -> Column:
    """Hours since midnight of ``H:mm`` text; NULL for anything else."""
    hour = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(:\d{2})?$", 1)
    minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(:\d{2})?$", 2)
    hours = hour.try_cast("double") + minute.try_cast("double") / F.lit(60.0)
    return F.when(hours < 24, hours)


def local_wall_time(utc_text: Column, zone: str) -> Column:
    """ISO text in UTC to wall-clock time in ``zone``, whatever the session zone is."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(utc_text), r"(Z|\+00:?00)$", ""), "T", " ")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), clean.try_cast("timestamp_ntz"))


def time_text(moment: Column) -> Column:
    return F.date_format(moment, "HH:mm:ss")
