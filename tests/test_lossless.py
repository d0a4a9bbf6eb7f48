"""Nothing that was typed is lost or counted twice without a word."""

import datetime
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F
from test_sheets import LATER, NEWEST, OLD

from tallywing.operators import linear, timing
from tallywing.operators.panel import one_edit_a_day
from tallywing.plans import season
from tallywing.sources.weather import normalise_station


def folder(**files):
    path = tempfile.mkdtemp(prefix="tallywing-lossless-")
    for name, body in files.items():
        with open(os.path.join(path, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(body)
    return f"{path}/*.csv"


def test_a_year_without_layout_fails(spark):
    with pytest.raises(Exception, match="no layout for the year of .*count_2031"):
        season.clean_panel(spark, folder(count_2020=LATER, count_2031=LATER)).collect()


def test_a_sheet_without_its_marker_fails(spark):
    assert "Visibility" in LATER
    with pytest.raises(Exception, match="no row that ends the environment band in .*count_2020"):
        season.clean_panel(spark, folder(count_2020=LATER.replace("Visibility", "Visibilty"))).collect()


def test_two_files_of_one_year_do_not_multiply(spark):
    for name, body in (("2020", LATER), ("2014", OLD), ("2024", NEWEST)):
        one = season.clean_panel(spark, folder(**{f"a_{name}": body}))
        two = season.clean_panel(spark, folder(**{f"a_{name}": body, f"b_{name}": body}))
        assert two.count() == 2 * one.count()
        assert two.agg(F.sum("birds")).first()[0] == 2 * one.agg(F.sum("birds")).first()[0]


def test_a_date_edited_twice_fails(spark):
    day = datetime.date(2024, 8, 21)
    edits = spark.createDataFrame([(day, "5:13"), (day, "5:13"), (None, "x"), (None, "y")], "date date, start_time string")
    assert one_edit_a_day(edits).where("date is not null").collect() == [(day, "5:13")]
    with pytest.raises(Exception, match="two hand edits for 2024-08-21"):
        one_edit_a_day(edits.unionByName(edits.limit(1).withColumn("start_time", F.lit("5:14")))).collect()


def test_readings_without_a_unit_cell_stay(spark):
    raw = spark.createDataFrame([("Pascals", "u"), (None, "a"), ("", "b"), ("101", "c")], "altimeter_set_1 string, wind_speed_set_1 string")
    assert sorted(r["wind_speed"] for r in normalise_station(raw).collect()) == ["a", "b", "c"]


def test_an_unknown_level_leaves_the_fit(spark):
    rows = [("g", 2000 + k % 5, level, 1.0 + (level == "b")) for k in range(40) for level in "ab"]
    daily = spark.createDataFrame(rows, "group string, year int, wind string, birds_per_hour double")
    odd = spark.createDataFrame([("g", 2001, "c", 500.0), ("g", 2002, None, 900.0)], daily.schema)
    for data in (daily, daily.unionByName(odd)):
        got = {r["term"]: r["estimate"] for r in linear.log_rate_model(data, {"wind": ["a", "b"]}, 2002).collect()}
        assert got["intercept"] == pytest.approx(0.693147, abs=1e-6) and got["wind=b"] == pytest.approx(0.405465, abs=1e-6)


def test_pooled_trend_is_the_random_intercept_model(spark):
    """Against the dense likelihood of y = a + b x + u_species + e on a balanced panel."""
    import numpy as np

    rng = np.random.default_rng(5)
    years, species = np.arange(2010, 2018), 6
    rows = [(f"s{k}", int(y), float(200 + level + 0.4 * (y - 2010) + rng.normal(0, 1.5)))
            for k, level in enumerate(rng.normal(0, 9, species)) for y in years]
    days = spark.createDataFrame(rows, "species string, year int, mean_doy double")
    trends = timing.species_trends(days)
    got = timing.pooled_trend(trends).first()
    y = np.asarray([r[2] for r in rows])
    x = np.column_stack([np.ones(len(rows)), [r[1] - 2013.5 for r in rows]])
    same = np.asarray([[a[0] == b[0] for b in rows] for a in rows], float)

    def fit(s2, u2):
        v = s2 * np.eye(len(y)) + u2 * same
        inverse = np.linalg.inv(v)
        covariance = np.linalg.inv(x.T @ inverse @ x)
        beta = covariance @ x.T @ inverse @ y
        r = y - x @ beta
        return -0.5 * (np.linalg.slogdet(v)[1] + r @ inverse @ r), beta, covariance

    best = fit(got["sigma2"], got["levels"])
    for a, b in ((1.02, 1), (0.98, 1), (1, 1.02), (1, 0.98)):
        assert fit(got["sigma2"] * a, got["levels"] * b)[0] < best[0]
    assert got["slope"] == pytest.approx(best[1][1]) and got["se"] == pytest.approx(np.sqrt(best[2][1, 1]))
    band = {r["year"]: r for r in timing.predict_all(days, trends).collect()}
    for year in (2010, 2014):
        at = np.asarray([1.0, year - 2013.5])
        assert (band[year]["conf_high"] - band[year]["predicted"]) / 1.96 == pytest.approx(np.sqrt(at @ best[2] @ at))


def test_a_fit_runs_from_another_folder():
    """Workers find the package's functions though neither their folder nor their path holds it."""
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from tallywing.session import local_session
from tallywing.operators import linear
spark = local_session(2)
rows = [("g", float(i), 2.0 * i + 1) for i in range(9)]
print([round(r["estimate"], 6) for r in linear.ols(spark.createDataFrame(rows, "group string, x double, y double"), "y", ["x"]).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300)
    assert "[1.0, 2.0]" in got.stdout, got.stderr[-2000:]
