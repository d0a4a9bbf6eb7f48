import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.functions import dates, numbers, special, text
from tallywing.functions.gamma import gamma_functions


@pytest.mark.parametrize("cell, kept, whole, stripped", [
    ("12", 12.0, 12.0, 12.0), (" 7 ", 7.0, 7.0, 7.0), ("12.7", 12.7, 12.0, 12.7), ("-3.5", -3.5, -3.0, -3.5),
    ("2,460", 0.0, 0.0, 2460.0), ("1*", 0.0, 0.0, 0.0), ("No Migrants", 0.0, 0.0, 0.0), ("", 0.0, 0.0, 0.0),
    ("12d", 0.0, 0.0, 0.0), ("NaN", 0.0, 0.0, 0.0), ("1e3", 1000.0, 1000.0, 1000.0), (None, 0.0, 0.0, 0.0),
    ("99999999999", 99999999999.0, 0.0, 99999999999.0),
])
def test_counts(one, cell, kept, whole, stripped):
    c = F.lit(cell).cast("string")
    assert one(numbers.parse_count(c)) == kept
    assert one(numbers.parse_count(c, whole=True)) == whole
    assert one(numbers.parse_count(c, thousands="strip")) == stripped


def test_count_option_is_checked():
    with pytest.raises(ValueError):
        numbers.parse_count(F.lit("1"), thousands="keep")


@pytest.mark.parametrize("cell, minutes, or_zero", [
    (None, 0, 0), ("", 0, 0), ("No Coverage", 0, 0), ("120", 120, 120), ("90.9", 90, 90), ("No Count", None, 0),
])
def test_minutes(one, cell, minutes, or_zero):
    c = F.lit(cell).cast("string")
    assert one(numbers.parse_minutes(c, ("", "No Coverage"))) == minutes
    assert one(numbers.parse_minutes(c, ("", "No Coverage"), True)) == or_zero


def test_ratio_of_zero_is_null(one):
    assert one(numbers.ratio(F.lit(5.0), F.lit(0.0))) is None


@pytest.mark.parametrize("values, printed", [
    ((1.7201, 1.061, 2.378), "1.72 (1.06 to 2.38)"), ((0.007, 0.001, 0.0149), "0.01 (0 to 0.01)"),
    ((-0.9, -2.83, 1.04), "-0.9 (-2.83 to 1.04)"), ((142.28, 75.63, 208.93), "142.28 (75.63 to 208.93)"),
    ((10.0, -0.001, 20000000.0), "10 (0 to 20000000)"),
])
def test_effect_text(one, values, printed):
    assert one(numbers.effect_text(*[F.lit(v) for v in values])) == printed


@pytest.mark.parametrize("typed, date", [
    ("8/14/14", "2014-08-14"), ("9-5-23", "2023-09-05"), ("09-11-20", "2020-09-11"), ("8/28/2021", "2021-08-28"),
    ("1/2/95", "1995-01-02"), ("11/22 thru 26", None), ("Species Totals", None), ("", None), ("13/1/20", None),
])
def test_header_dates(one, typed, date):
    got = one(dates.parse_us_date(F.lit(typed)))
    assert got == (None if date is None else datetime.date.fromisoformat(date))


def test_day_label_counts_from_a_leap_year(one):
    assert one(dates.day_label(F.lit(274))) == "Oct-01"


@pytest.mark.parametrize("typed, padded, hours", [("6:15", "06:15", 6.25), ("6;30", "06:30", 6.5), ("14:45", "14:45", 14.75), ("dawn", "dawn", None)])
def test_clock(one, typed, padded, hours):
    assert one(text.pad_clock(F.lit(typed))) == padded
    assert one(dates.clock_hours(text.pad_clock(F.lit(typed)))) == hours


def test_wall_time_ignores_the_session_zone(spark, one):
    column = dates.local_wall_time(F.lit("2023-07-01T04:30:00Z"), "America/New_York")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert one(column.cast("string")) == "2023-07-01 00:30:00"
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_first_match_only(one):
    assert one(text.strip_first(F.lit("NA; 6-8; NA; 9"), "NA; ")) == "6-8; NA; 9"
    assert one(text.replace_first(F.lit("a.b.c"), r"\.", "-")) == "a-b.c"


def test_join_present(one):
    nothing = F.lit(None).cast("string")
    assert one(text.join_present("; ", F.lit("6-8"), nothing)) == "6-8"
    assert one(text.join_present("; ", nothing, nothing)) is None


def test_null_rules(one):
    assert one(text.null_if_in(F.lit("No Count"), "", "No Count")) is None
    assert one(text.null_if_matches(F.lit("Calm 1-3"), "Calm")) is None
    assert one(text.leading_word(F.lit("NW 7mph"))) == "NW"
    assert one(text.leading_digits(F.lit("513-1013"))) == "513"


@pytest.mark.parametrize("x", [1e-4, 0.3, 1.0, 2.5, 17.0, 1234.5, 1e7])
def test_gamma_functions(one, x):
    step = 1e-4 * x
    lg, dg, tg = (f[0] for f in gamma_functions(np.array([x])))
    assert lg == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
    assert dg == pytest.approx((math.lgamma(x + step) - math.lgamma(x - step)) / (2 * step), rel=1e-5, abs=1e-6)
    up, down = gamma_functions(np.array([x + step]))[1][0], gamma_functions(np.array([x - step]))[1][0]
    assert tg == pytest.approx((up - down) / (2 * step), rel=1e-5)
    assert one(special.log_gamma(F.lit(x))) == pytest.approx(lg, rel=1e-12, abs=1e-12)
    assert one(special.digamma(F.lit(x))) == pytest.approx(dg, rel=1e-12)
    assert one(special.trigamma(F.lit(x))) == pytest.approx(tg, rel=1e-12)


@pytest.mark.parametrize("t, df, p", [
    (1.18156501230554, 97, 0.240267061475443), (2.5073986343159, 97, 0.0138235190986707), (1.94878749093848, 97, 0.0542100026507017),
    (0.0, 5, 1.0), (1.0, 1, 0.5), (-2.0, 2, 0.1835034190722739), (2.228138852, 10, 0.05), (5.0, 0, None),
])
def test_student_p(one, t, df, p):
    got = one(special.student_two_sided_p(F.lit(t), F.lit(df)))
    assert got is None if p is None else got == pytest.approx(p, abs=1e-9)


def test_normal_p(one):
    assert one(special.normal_two_sided_p(F.lit(1.959963985))) == pytest.approx(0.05, abs=1e-9)
