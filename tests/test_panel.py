import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallywing.operators import composition, panel, summary, wind
from tallywing.operators.labels import OWN_GROUP
from tallywing.plans.season import focal_panel, modelling_table


def day(n):
    return datetime.date(2020, 9, n)


@pytest.fixture(scope="module")
def counts(spark):
    data = [
        ("A", day(1), 2020, 10.0, 2.0, "x"), ("B", day(1), 2020, 0.0, 2.0, "x"), ("A", day(2), 2020, 0.0, 0.0, None),
        ("B", day(2), 2020, 4.0, 0.0, None), ("A", day(3), 2021, 6.0, 3.0, "y"), ("B", day(3), 2021, 0.0, None, "y"),
    ]
    return spark.createDataFrame(data, "species string, date date, year int, birds double, obs_hours double, observer string")


def test_keep_rule(counts):
    kept = {(r["species"], r["date"].day) for r in panel.drop_no_effort(counts).collect()}
    assert kept == {("A", 1), ("B", 1), ("B", 2), ("A", 3)}


def test_effort_counts_each_day_once(counts):
    assert summary.total_effort(counts.filter("obs_hours is not null")).first()[0] == 5.0
    assert summary.repeated_effort(counts.filter("obs_hours is not null")).first()[0] == 7.0


def test_rate_by_year(counts):
    got = {r["year"]: (r["total_birds"], r["birds_per_hour"]) for r in summary.rate_by_year(counts.filter("date = '2020-09-02'")).collect()}
    assert got == {2020: (4.0, None)}  # hours of zero give NULL, not an error


def test_daily_rate_skips_days_without_effort(counts):
    got = summary.daily_rate(counts, ["date", "obs_hours"]).collect()
    assert {(r["date"].day, r["birds_per_hour"]) for r in got} == {(1, 5.0), (3, 2.0)}


def test_detection(counts):
    assert {tuple(r) for r in summary.detection_days(counts).collect()} == {("A", 2), ("B", 1)}
    assert {tuple(r) for r in summary.seen_every_period(counts).collect()} == {("A", 2)}
    assert {r["species"] for r in panel.frequent_only(counts, 1).select("species").distinct().collect()} == {"A"}


def test_unidentified_pattern_has_a_wildcard(spark):
    df = spark.createDataFrame([("OSPR",), ("Loon sp.",), ("Gull Sp.",), ("DCCO",)], "species string")
    assert [r[0] for r in panel.without_unidentified(df).collect()] == ["DCCO"]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, 3)], "x int, y int")
    assert {tuple(r) for r in panel.union_seasons([a, b]).collect()} == {(1, None), (2, 3)}


def test_composition_percent_is_of_the_kept_rows(spark):
    df = spark.createDataFrame([(f"g{i}", float(i)) for i in range(1, 11)], "grouping string, total_birds double")
    got = composition.composition(df, "grouping", "total_birds").collect()
    assert len(got) == 8 and sum(r["percent"] for r in got) == pytest.approx(100.0)
    assert got[0]["percent"] == pytest.approx(100 * 10 / sum(range(3, 11)))


def test_composition_folds_groups(spark):
    totals = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "species string, total_birds double")
    groups = spark.createDataFrame([("a", "Larids"), ("b", "Grebes"), ("c", "Alcids")], "species string, grouping string")
    got = {r["grouping"]: (r["total"], r["plot_order"]) for r in composition.flight_composition(totals, groups).collect()}
    assert got == {"Gulls": (5.0, 7), "Other waterbirds": (5.0, 8)}


def readings(spark, data):
    schema = "datetime timestamp_ntz, wind_speed double, wind_direction double, pressure double"
    stamped = [(datetime.datetime(2020, 9, 1, h, m), *rest) for (h, m), *rest in data]
    return spark.createDataFrame(stamped, schema).withColumn("date", F.col("datetime").cast("date"))


def test_mean_of_equal_winds_is_that_wind(spark):
    got = wind.daily_weather(readings(spark, [((6, 0), 4.0, 250.0, 1000.0), ((7, 0), 4.0, 250.0, 1010.0)])).first()
    assert got["wind_dir"] == pytest.approx(250.0) and got["wind_speed"] == 4.0 and got["pressure"] == 1005.0


def test_wind_crosses_north(spark):
    got = wind.daily_weather(readings(spark, [((6, 0), 4.0, 350.0, None), ((7, 0), 4.0, 20.0, 1010.0)])).first()
    assert got["wind_dir"] == pytest.approx(5.0) and got["pressure"] == 1010.0


def test_day_part_bounds(spark):
    got = wind.day_part(readings(spark, [((2, 59), 1.0, 0.0, 0.0), ((3, 0), 1.0, 0.0, 0.0), ((19, 14), 1.0, 0.0, 0.0), ((19, 15), 1.0, 0.0, 0.0)]))
    assert got.count() == 2


def test_station_file(spark):
    import tempfile

    from tallywing.sources.weather import read_station

    path = tempfile.mkdtemp(prefix="tallywing-station-") + "/station.csv"
    with open(path, "w") as f:
        f.write("Date_Time,altimeter_set_1,wind_speed_set_1,wind_direction_set_1,pressure_set_1d\n"
                ",Pascals,m/s,Degrees,Pascals\n2023-11-05T02:00:00Z,101,2.5,270,1001.23456\n2023-11-06T02:00:00Z,101,,90,x\n")
    got = [tuple(r) for r in read_station(spark, path).orderBy("datetime").collect()]
    assert got == [
        (datetime.datetime(2023, 11, 4, 22, 0), datetime.date(2023, 11, 4), 2.5, 270.0, 1001.235),  # summer time
        (datetime.datetime(2023, 11, 5, 21, 0), datetime.date(2023, 11, 5), None, 90.0, None),
    ]


def test_station_names():
    from tallywing.sources.weather import plain_name

    assert [plain_name(n) for n in ("Date_Time", "wind_speed_set_1", "pressure_set_1d")] == ["date_time", "wind_speed", "pressure"]


def test_modelling_table_and_focal_species(spark):
    rows = [(s, datetime.date(y, 9, 1), y, float(n), 2.0) for y in (2020, 2021) for s, n in (("DCCO", 3), ("RAZO", 2 if y == 2020 else 0), ("Loon sp.", 5))]
    counts = spark.createDataFrame(rows, "species string, date date, year int, birds double, obs_hours double")
    groups = spark.createDataFrame([("DCCO", "Cormorants", "Seabirds"), ("RAZO", "Alcids", "Seabirds"), ("Loon sp.", "Loons", "Seabirds")],
                                   "species string, grouping string, grouping3 string")
    weather = spark.createDataFrame([(datetime.date(2020, 9, 1), 90.0, 5.0, 1000.0), (datetime.date(2021, 9, 1), 180.0, 5.0, 1000.0)],
                                    "date date, wind_dir double, wind_speed double, pressure double")
    edits = spark.createDataFrame([(datetime.date(2020, 9, 1), "6:15")], "date date, start_time string")
    table = modelling_table(counts, groups, weather, edits)
    first = table.filter("species = 'DCCO' and year = 2020").first()
    assert first["grouping2"] == OWN_GROUP["DCCO"] and first["tsm"] == 6.25 and first["doy"] == 245
    assert first["wind_dir_cos"] == pytest.approx(math.cos(90.0))  # degrees read as radians
    right = modelling_table(counts, groups, weather, edits, unit="degrees").filter("species = 'DCCO' and year = 2020").first()
    assert right["wind_dir_cos"] == pytest.approx(0.0, abs=1e-12)
    assert {r[0] for r in focal_panel(table).select("species").distinct().collect()} == {"DCCO"}
