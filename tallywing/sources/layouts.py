"""Fixed values of the yearly field sheets: where bands end, which cells are sentinels, date slips.

These are data facts about eleven seasons of sheets, stated as plain tables. A new season is one
more line in ``LAYOUTS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Year, preamble lines, last label of the environment band, first label after the
# species band (None: to the end of the file), header texts that are totals, whole-number counts.
LAYOUTS = [
    (2014, 1, "Visitors", None, ["TOTALS"], False),
    (2015, 0, "principle.observer", "Daily Totals", ["Species Totals"], False),
    (2016, 0, "General Wind Dir/Velocity", "Season Total", ["Species Totals"], False),
    (2017, 0, "General Wind Dir/Velocity", "Season Totals", ["Species Totals"], False),
    (2018, 0, "Visibility", "Total", [], False),
    (2019, 0, "Visibility", "Total", [], False),
    (2020, 0, "Visibility", "Total", [], False),
    (2021, 1, "Visibility", "Total", ["Running Season Totals"], True),
    (2022, 1, "Visibility", "Total", ["Running Season Totals"], True),
    (2023, 0, "Visibility (miles)", "Total", [], True),
    (2024, 0, "Visibility (miles)", "Total", ["TOTALS"], True),
]
LAYOUT_SCHEMA = (
    "sheet_year int, skip int, env_end string, species_end string, "
    "total_headers array<string>, whole_counts boolean"
)

# Header texts that were typed wrongly, by year.
DATE_FIXES = {
    (2021, "10/16/12"): "10/16/21",
    (2021, "11/21"): "11/21/21",
}

# Dotted environment labels and the panel column each one feeds.
ENVIRONMENT_NAMES = {
    "minutes.of.observation": "total_obs_mins",
    "time(s).of.observation": "time_of_obs",
    "time": "time_of_obs",
    "to2": "time_of_obs_2",
    "principle.observer": "observer",
    "observer": "observer",
    "general.wind.dir/velocity": "wind_dir_speed",
    "wind": "wind_dir_speed",
    "visibility": "visibility",
    "visibility.(miles)": "visibility",
}
ENVIRONMENT_COLUMNS = [
    "total_obs_mins", "time_of_obs", "time_of_obs_2", "observer", "wind_dir_speed", "visibility",
]

# Effort texts that mean no minutes.
ZERO_MINUTES = ("", "No Coverage")
ZERO_MINUTES_FROM_2022 = ("", "No Coverage", "No Count")

# Environment cells that mean "unknown", as (column, text, first year, last year).
SENTINELS = [
    ("time_of_obs", "", 2014, 2024),
    ("time_of_obs", '"', 2016, 2016),
    ("time_of_obs", "count not completed because of hurriane Dorian", 2019, 2019),
    ("time_of_obs", "No Count", 2023, 2024),
    ("time_of_obs_2", "", 2016, 2016),
    ("observer", "", 2014, 2024),
    ("wind_dir_speed", "", 2016, 2024),
    ("visibility", "", 2018, 2024),
    ("visibility", "No Count", 2023, 2024),
    ("visibility", "No Counts", 2023, 2024),
]


def layout_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUTS, LAYOUT_SCHEMA)
