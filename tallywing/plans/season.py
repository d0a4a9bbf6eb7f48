"""The survey's own jobs, from a folder of yearly sheets to the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywing.functions.dates import clock_hours, parse_us_date
from tallywing.functions.numbers import parse_count, parse_minutes
from tallywing.functions.text import join_present, pad_clock
from tallywing.operators import labels
from tallywing.operators.panel import (
    PANEL_COLUMNS, attach_days, attach_groups, attach_hand_edits, collapse_duplicates, covariates,
    derive_rates, drop_no_effort, in_species, one_edit_a_day, own_group, without_labels,
)
from tallywing.operators.recode import lookup, recode
from tallywing.operators.summary import seen_every_period
from tallywing.sources import layouts, sheets


def _by_year(label: Column, year: Column, rules: dict[int, list[tuple[str, str | None]]]) -> Column:
    """Season-specific recode: one branch per season."""
    out = label
    for season, chain in rules.items():
        out = F.when(year == season, recode(label, chain)).otherwise(out)
    return out


def _fixed_header(year: Column):
    pairs = {f"{season}|{text}": new for (season, text), new in layouts.DATE_FIXES.items()}

    def fix(header: Column) -> Column:
        return F.coalesce(lookup(F.concat(year.cast("string"), F.lit("|"), header), pairs), header)

    return fix


def _unknown(column: str, year: Column) -> Column:
    """NULL for the cells a season uses to say "unknown"."""
    value = F.col(column)
    hit = F.lit(False)
    for name, text, first, last in layouts.SENTINELS:
        if name == column:
            hit = hit | ((value == text) & year.between(first, last))
    return F.when(~hit, value)


def read_season_bands(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All sheets under ``path`` as tagged rows and day headers. The year comes from the file name.

    Nothing is left out silently: a file whose year has no layout, a sheet without its marker row and a sheet with two
    columns for one date fail, naming the file.
    """
    raw = sheets.read_sheets(spark, path).withColumn(
        "sheet_year", F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d{4})", 1).cast("int")
    )
    laid = raw.join(layouts.layout_table(spark), "sheet_year", "left")
    unknown = F.raise_error(F.concat(F.lit("no layout for the year of "), F.col("file")))
    laid = sheets.skip_preamble(laid.withColumn("skip", F.coalesce("skip", unknown)), F.col("skip"))
    headers = sheets.header_cells(
        laid, drop=F.array_contains("total_headers", F.col("header")), fix=_fixed_header(F.col("sheet_year"))
    )
    headers = headers.select("file", "pos", parse_us_date(F.col("header")).alias("header")).filter("header is not null")
    copies = F.count("*").over(Window.partitionBy("file", "header"))
    twice = F.raise_error(F.concat(F.lit("two columns for "), F.col("header").cast("string"), F.lit(" in "), F.col("file")))
    headers = headers.withColumn("header", F.when(copies == 1, F.col("header")).otherwise(twice))
    rows = sheets.band_rows(laid, F.col("env_end"), F.col("species_end"))
    return rows, headers


def season_effort(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per sheet and survey date: minutes, times, observer, wind and visibility texts."""
    long = sheets.unpivot_cells(rows.filter("band = 'environment'"), headers, keep=["sheet_year"])
    wide = sheets.environment_table(
        long, layouts.ENVIRONMENT_NAMES, layouts.ENVIRONMENT_COLUMNS, keys=("file", "sheet_year", "header")
    )
    year = F.col("sheet_year")
    minutes = F.when(
        year >= 2022, parse_minutes(F.col("total_obs_mins"), layouts.ZERO_MINUTES_FROM_2022, year >= 2023)
    ).otherwise(parse_minutes(F.col("total_obs_mins"), layouts.ZERO_MINUTES))
    cleaned = wide.select(
        "file", "sheet_year", F.col("header").alias("date"), minutes.alias("total_obs_mins"),
        *[_unknown(c, year).alias(c) for c in layouts.ENVIRONMENT_COLUMNS if c != "total_obs_mins"],
    )
    return cleaned.withColumn("time_of_obs", F.when(
        year == 2016, join_present("; ", F.col("time_of_obs"), F.col("time_of_obs_2"))
    ).otherwise(F.col("time_of_obs"))).drop("time_of_obs_2")


def season_counts(rows: DataFrame, headers: DataFrame, thousands: str = "null") -> DataFrame:
    """Long counts ``(file, sheet_year, species, date, birds)`` with labels corrected per season."""
    long = sheets.unpivot_cells(rows.filter("band = 'species'"), headers, keep=["sheet_year", "whole_counts"])
    year = F.col("sheet_year")
    counted = long.select(
        "file", year, F.col("header").alias("date"),
        _by_year(F.col("label"), year, labels.SPECIES_BY_YEAR).alias("species"),
        parse_count(F.col("cell"), F.col("whole_counts"), thousands).alias("birds"),
    )
    other = F.lit(False)
    for season, names in labels.NOT_BIRDS.items():
        other = other | ((year == season) & F.col("species").isin(*names))
    return counted.filter(~other)


def clean_panel(spark: SparkSession, path: str, thousands: str = "null", collapse_from: int = 2024) -> DataFrame:
    """Sheets to the clean panel. Seasons from ``collapse_from`` on are summed per sheet, species and day.

    Counts meet the effort of their own sheet, so that a season may lie in any number of files.
    """
    rows, headers = read_season_bands(spark, path)
    counts = season_counts(rows, headers, thousands)
    late = F.col("sheet_year") >= collapse_from
    summed = collapse_duplicates(counts.filter(late), ["file", "sheet_year", "species", "date"])
    counts = counts.filter(~late).unionByName(summed)
    counts = counts.withColumn(
        "species", recode(_by_year(F.col("species"), F.col("sheet_year"), labels.SPECIES_AFTER_SUM), labels.SPECIES_ALL_YEARS)
    )
    joined = attach_days(counts, season_effort(rows, headers).drop("sheet_year"), ["file", "date"])
    observer = _by_year(F.col("observer"), F.col("sheet_year"), labels.OBSERVERS_BY_YEAR)
    joined = joined.withColumn("observer", recode(observer, labels.OBSERVERS_ALL_YEARS))
    return derive_rates(joined).select(*PANEL_COLUMNS)


def analysis_panel(panel: DataFrame) -> DataFrame:
    """The rows the analysis uses: later seasons, merged labels, local gulls left out."""
    merged = panel.withColumns({
        "observer": recode(F.col("observer"), labels.OBSERVERS_ANALYSIS),
        "species": recode(F.col("species"), labels.SPECIES_ANALYSIS),
    })
    return merged.filter(~F.col("year").isin(*labels.SKIPPED_YEARS)).filter(~F.col("species").isin(*labels.SKIPPED_SPECIES))


def modelling_table(panel: DataFrame, groups: DataFrame, weather: DataFrame, edits: DataFrame, unit: str = "as_is") -> DataFrame:
    """Panel with groups, daily weather, start time and covariates; rows without effort dropped.

    A date edited twice fails: it would count its birds twice.
    """
    start = one_edit_a_day(edits.select("date", "start_time"))
    joined = attach_hand_edits(attach_groups(attach_days(panel, weather), groups), start)
    named = joined.withColumns({
        "grouping2": own_group(F.col("species"), F.col("grouping"), labels.OWN_GROUP),
        "tsm": clock_hours(pad_clock(F.col("start_time"))),
    })
    return covariates(drop_no_effort(named), unit=unit)


def focal_panel(modelling: DataFrame, group_column: str = "grouping3") -> DataFrame:
    """Identified species of the focal group that were seen in every year."""
    focal = without_labels(modelling.filter(F.col(group_column) == labels.FOCAL_GROUP), labels.NOT_SPECIES)
    return in_species(focal, seen_every_period(focal))
