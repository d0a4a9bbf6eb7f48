import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tallywing.operators import labels, quality
from tallywing.operators import summary as s
from tallywing.operators.panel import drop_no_effort
from tallywing.operators.recode import closure, factor_code, recode
from tallywing.plans import season
from tallywing.sources import sheets, tables

# Old layout: preamble, TOTALS column, band end at Visitors, no end marker.
OLD = """Table 1,,,
,8/14/14,8/18/14,TOTALS
Observer,Keith,Seth,
Wind,NE 3,Calm,
minutes.of.observation,120,No Coverage,
Time,6:30-8:30,,
Temp.,60 F,61 F,
Visitors,0,3,3
COGE,5,1*,6
Monarch,3,4,7
Black Duck,,2,2
"""
# Later layout: a quoted newline, a repeated header, blank spacer rows, a footer.
LATER = """Date,,09-11-20,09-12-20,09-11-20,9/13/2020
Minutes of Observation,600,300,0,,60
Time(s) of Observation,,"0600-1100
with a break",,,0600-0700
Principle Observer,,Benz/Klyver,ZK,,SS
General Wind Dir/Velocity,,N 3,,,
Visibility,,10 miles,,,
,Running Totals,,,,
DCCO,20,10,,99,"2,460"
UNBI,2,0,,99,2
,,,,,
Total,22,10,0,198,2
Notes,,windy,,,
"""
# Whole counts, two spellings of one label, dates to drop.
NEWEST = """Date,TOTALS,8/21/24,8-22-24,11/22 thru 26
Minutes of Observation,"21,376",300,No Count,10
Time(s) of Observation,,513-1013,No Count,1-2
Principle Observer,,Nick Hoffmann,S. Benz,SB
General Wind Dir/Velocity,,W 2mph,,
Visibility (miles),,20,No Counts,3
Osprey,3,2.9,1,50
OSPR,3,1,0,50
Large Alcid,1,1,,9
Total,6,4,1,100
"""


@pytest.fixture(scope="module")
def folder():
    path = tempfile.mkdtemp(prefix="tallywing-sheets-")
    for name, body in (("count_2014.csv", OLD), ("count_2020.csv", LATER), ("count_2024.csv", NEWEST)):
        with open(os.path.join(path, name), "w", encoding="utf-8", newline="") as f:
            f.write(body.replace("\n", "\r\n"))
    return path


@pytest.fixture(scope="module")
def panel(spark, folder):
    return season.clean_panel(spark, f"{folder}/*.csv").cache()


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_reader_keeps_order_and_width(spark, folder):
    got = sheets.read_sheets(spark, f"{folder}/count_2020.csv").orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(12))
    assert got[2]["cells"][1].startswith("0600-1100") and "break" in got[2]["cells"][1]
    assert got[7]["cells"][:5] == ["20", "10", "", "99", "2,460"]


def test_a_row_too_wide_fails(spark, folder):
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        sheets.read_sheets(spark, f"{folder}/*.csv", max_columns=4).collect()


def test_old_layout(panel):
    got = rows(panel.filter("year = 2014"), "species", "date", "birds", "total_obs_mins", "observer")
    d1, d2 = datetime.date(2014, 8, 14), datetime.date(2014, 8, 18)
    assert got == {
        ("COGO", d1, 5.0, 120, "KO"), ("COGO", d2, 0.0, 0, "SB"), ("Black Duck", d1, 0.0, 120, "KO"), ("Black Duck", d2, 2.0, 0, "SB"),
    }


def test_later_layout(panel):
    got = rows(panel.filter("year = 2020"), "species", F.dayofmonth("date"), "birds", "obs_hours", "birds_per_hour", "observer")
    assert got == {
        ("DCCO", 11, 10.0, 5.0, 2.0, "SB/ZK"), ("DCCO", 12, 0.0, 0.0, None, "ZK"), ("DCCO", 13, 0.0, 1.0, 0.0, "ZS"),
        ("Bird sp.", 11, 0.0, 5.0, 0.0, "SB/ZK"), ("Bird sp.", 12, 0.0, 0.0, None, "ZK"), ("Bird sp.", 13, 2.0, 1.0, 2.0, "ZS"),
    }
    texts = rows(panel.filter("year = 2020 and species = 'DCCO'"), F.dayofmonth("date"), "wind_dir_speed", "visibility")
    assert texts == {(11, "N 3", "10 miles"), (12, None, None), (13, None, None)}


def test_newest_layout_sums_spellings_and_truncates(panel):
    got = rows(panel.filter("year = 2024"), "species", F.dayofmonth("date"), "birds", "total_obs_mins", "observer", "time_of_obs", "visibility")
    assert got == {
        ("OSPR", 21, 3.0, 300, "NH", "513-1013", "20"), ("OSPR", 22, 1.0, 0, "SB", None, None),
        ("Alcid sp.", 21, 1.0, 300, "NH", "513-1013", "20"), ("Alcid sp.", 22, 0.0, 0, "SB", None, None),
    }


def test_thousands_can_be_kept(spark, folder):
    kept = season.clean_panel(spark, f"{folder}/*2020*.csv", thousands="strip")
    assert kept.filter("species = 'DCCO'").agg(F.sum("birds")).first()[0] == 2470.0


def test_analysis_panel(panel):
    got = season.analysis_panel(panel)
    assert rows(got.filter("year = 2020"), "observer") == {("SB/RZK",), ("RZK",), ("ZS",)}
    assert got.filter("year = 2014").isEmpty()


def test_no_effort_rows_leave(panel):
    kept = drop_no_effort(panel)
    assert kept.filter("obs_hours = 0 and birds = 0").isEmpty()
    assert kept.filter("obs_hours = 0").count() == 2  # birds without hours stay


def test_unpivot_and_pivot_are_inverse(spark):
    wide = spark.createDataFrame(
        [("f", 0, "Date", ["1/1/20", "1/2/20"]), ("f", 1, "a", ["1", "2"]), ("f", 2, "b", ["3", ""])],
        "file string, row_idx int, label string, cells array<string>",
    )
    long = sheets.unpivot_cells(wide.filter("row_idx > 0"), sheets.header_cells(wide, F.lit(False)))
    back = long.groupBy("label").pivot("header", ["1/1/20", "1/2/20"]).agg(F.first("cell"))
    assert rows(back, "*") == {("a", "1", "2"), ("b", "3", "")}


def test_rules_are_ordered():
    assert closure([("a", "b"), ("b", "c")]) == {"a": "c", "b": "c"}
    assert closure([("b", "c"), ("a", "b")]) == {"b": "c", "a": "b"}
    chained = closure(labels.OBSERVERS_ALL_YEARS + labels.OBSERVERS_ANALYSIS)
    assert chained["Benz/Klyver"] == "SB/RZK" and chained["RZK/STB"] == "SB/RZK" and chained[""] is None


def test_recode_leaves_others_and_null(spark):
    df = spark.createDataFrame([("a",), ("x",), ("z",), (None,)], "label string")
    got = df.select("label", recode(F.col("label"), [("a", "b"), ("z", None)]).alias("new"))
    assert rows(got, "*") == {("a", "b"), ("x", "x"), ("z", None), (None, None)}


def test_factor_code(spark):
    df = spark.createDataFrame([("lo",), ("hi",), ("?",)], "x string")
    assert rows(df.select("x", factor_code(F.col("x"), ["lo", "hi"])), "*") == {("lo", 1), ("hi", 2), ("?", None)}


def test_lookup_reads_na_as_null(spark):
    path = tempfile.mkdtemp(prefix="tallywing-lookup-") + "/groups.csv"
    with open(path, "w") as f:
        f.write("species,grouping,grouping3\nABDU,Ducks,NA\nCOEI,Ducks,Seabirds\n")
    got = tables.read_lookup(spark, path, "species string, grouping string, grouping3 string")
    assert rows(got, "species", "grouping3") == {("ABDU", None), ("COEI", "Seabirds")}


def test_hand_edits(spark):
    path = tempfile.mkdtemp(prefix="tallywing-edits-") + "/edits.csv"
    with open(path, "w") as f:
        f.write("date,wind.direction,start.time,start.time.2,visibility.score\n8/21/24,WSW,5:13,,NA\n8/22/24,SW,5:14,,4\n")
    got = tables.read_hand_edits(spark, path)
    assert rows(got, "date", "start_time", "visibility_score") == {
        (datetime.date(2024, 8, 21), "5:13", None), (datetime.date(2024, 8, 22), "5:14", "4")}
    assert tables.union_hand_edits(got.unionByName(got), got.select("date", "start_time")).count() == 4


SHEETS = os.environ.get("FIELD_SHEETS_DIR")


@pytest.mark.skipif(not SHEETS, reason="FIELD_SHEETS_DIR names no folder of yearly sheets")
def test_published_figures(spark):
    """Eleven real seasons: the published days, hours, birds, observers and focal species."""
    full = season.analysis_panel(season.clean_panel(spark, f"{SHEETS}/*.csv")).cache()
    kept = drop_no_effort(full)
    assert s.survey_days(kept).first()[0] == 655
    assert [r["days"] for r in s.days_per_year(kept).orderBy("year").collect()] == [67, 64, 71, 70, 72, 81, 50, 92, 88]
    assert s.total_effort(full).first()[0] == pytest.approx(2562.8333, abs=1e-3)
    assert s.total_birds(full).first()[0] == 490208
    assert quality.distinct_values(full.filter("observer is not null"), "observer").count() == 29
    cormorant = kept.filter("species = 'DCCO'")
    assert s.totals(cormorant, "species").first()["total_birds"] == 178433
    assert s.detection_days(cormorant).first()["detection_days"] == 576
    earlier = full.filter("year < 2024")
    assert s.survey_days(earlier).first()[0] == 626
    assert s.total_birds(earlier).first()[0] == 449707
    assert s.repeated_effort(earlier).first()[0] == pytest.approx(119247.2, abs=0.01)
