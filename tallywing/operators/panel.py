"""Building and enriching the panel: joins, derived columns and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.operators.recode import lookup
from tallywing.session import settle

PANEL_COLUMNS = [
    "species", "date", "year", "time_of_obs", "total_obs_mins", "obs_hours", "birds",
    "birds_per_hour", "wind_dir_speed", "visibility", "observer",
]


def derive_rates(df: DataFrame) -> DataFrame:
    """Year, hours and birds per hour; the last needs the second, so it comes in a later step."""
    hours = df.withColumns({
        "year": F.year("date"),
        "obs_hours": F.col("total_obs_mins") / F.lit(60.0),
    })
    return hours.withColumn("birds_per_hour", ratio(F.col("birds"), F.col("obs_hours")))


def attach_days(panel: DataFrame, days: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Left join a table with one row per calendar date (or per sheet and date).

    No hint: adaptive execution broadcasts the table where its measured size allows, and else splits skewed dates.
    """
    return panel.join(days, list(keys), "left")


def attach_hand_edits(panel: DataFrame, edits: DataFrame) -> DataFrame:
    """Left join edited columns by date. A date edited twice fans out, so nothing is hinted here."""
    return panel.join(edits, "date", "left")


def one_edit_a_day(edits: DataFrame) -> DataFrame:
    """``edits`` as they are, if no date stands twice; else the job fails, naming the date. Equal rows count as one."""
    rest = [c for c in edits.columns if c != "date"]
    found = edits.distinct().groupBy("date").agg(F.count("*").alias("n"), F.first(F.struct(*rest)).alias("edit"))
    twice = F.raise_error(F.concat(F.lit("two hand edits for "), F.coalesce(F.col("date").cast("string"), F.lit("no date"))))
    kept = F.when((F.col("n") == 1) | F.col("date").isNull(), F.col("edit")).otherwise(twice)
    return found.select("date", kept.alias("edit")).select("date", *[f"edit.{c}" for c in rest])


def attach_groups(panel: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join the species lookup; Catalyst broadcasts it when its real size allows."""
    return panel.join(groups, "species", "left")


def own_group(species: Column, grouping: Column, table: dict[str, str]) -> Column:
    """Group of a species, unless the species stands as its own group."""
    return F.coalesce(lookup(species, table), grouping)


def no_effort(birds: Column, hours: Column) -> Column:
    return (birds == 0) & (hours == 0)


def drop_no_effort(panel: DataFrame) -> DataFrame:
    """Drop rows with neither birds nor hours; a row whose test is unknown goes too."""
    return panel.filter(~no_effort(F.col("birds"), F.col("obs_hours")))


def collapse_duplicates(counts: DataFrame, keys: Sequence[str] = ("species", "date"), value: str = "birds") -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum(value).alias(value))


def without_labels(panel: DataFrame, labels: Iterable[str]) -> DataFrame:
    return panel.filter(~F.col("species").isin(*labels))


def without_unidentified(panel: DataFrame, pattern: str = "(?i)sp.") -> DataFrame:
    """Drop labels that match; the dot is a wildcard, so ``OSPR`` goes as well."""
    return panel.filter(~F.col("species").rlike(pattern))


def union_seasons(seasons: Sequence[DataFrame]) -> DataFrame:
    """Seasons stacked by column name; columns a season lacks become NULL."""
    out = seasons[0]
    for season in seasons[1:]:
        out = out.unionByName(season, allowMissingColumns=True)
    return out


def covariates(panel: DataFrame, wind_dir: str = "wind_dir", unit: str = "as_is") -> DataFrame:
    """Day of year and the two wind components.

    ``unit="as_is"`` feeds the angle to sin and cos unchanged, the behaviour the published models
    rest on (degrees read as radians); ``"degrees"`` converts first.
    """
    if unit not in ("as_is", "degrees"):
        raise ValueError("unit must be 'as_is' or 'degrees'")
    angle = F.col(wind_dir) if unit == "as_is" else F.radians(wind_dir)
    return panel.withColumns({
        "doy": F.dayofyear("date"),
        "wind_dir_cos": F.cos(angle),
        "wind_dir_sin": F.sin(angle),
    })


MODEL_KEYS = [
    "date", "year", "doy", "tsm", "species", "total_obs_mins", "obs_hours", "wind_speed",
    "wind_dir_cos", "wind_dir_sin", "pressure", "observer",
]


def model_frame(panel: DataFrame, keys: Sequence[str] = tuple(MODEL_KEYS)) -> DataFrame:
    """One row per day and species with every covariate known.

    Rows with a NULL key cannot survive the complete-case rule, so they leave before the shuffle.
    """
    return panel.dropna("any", subset=list(keys)).groupBy(*keys).agg(F.sum("birds").alias("birds")).dropna("any")


def detections(panel: DataFrame) -> DataFrame:
    """Rows with at least one bird, counted by species."""
    return panel.filter("birds > 0").groupBy("species").agg(F.count("*").alias("n"))


def frequent_only(panel: DataFrame, more_than: int) -> DataFrame:
    """Rows of species with more than ``more_than`` detections, with that number beside them.

    The count is a separate aggregate joined back, not a window: a window would send every row of a
    common species to one task. It is settled first, so that the join knows its size.
    """
    return panel.join(settle(detections(panel).filter(F.col("n") > more_than), "detections"), "species")


def in_species(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen species. The list is settled first: a list of true size that fits is
    broadcast, and the panel is shuffled only for one that does not."""
    return panel.join(settle(chosen.select("species"), "species"), "species", "left_semi")
