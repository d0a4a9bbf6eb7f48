"""Share of the flight by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.operators.labels import COMPOSITION_FOLDS, COMPOSITION_LEVELS
from tallywing.operators.recode import factor_code, recode
from tallywing.operators.summary import top


def fold_groups(grouping: Column) -> Column:
    return recode(grouping, COMPOSITION_FOLDS)


def composition(counts: DataFrame, group: str, value: str, k: int = 8) -> DataFrame:
    """Totals of the k largest groups and each one's percent of those k.

    The window runs over k rows, after the cut.
    """
    summed = counts.groupBy(group).agg(F.sum(value).alias("total"))
    kept = top(summed, k, "total", group)
    return kept.withColumn("percent", 100.0 * ratio(F.col("total"), F.sum("total").over(Window.partitionBy())))


def flight_composition(species_totals: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """Composition report from ``(species, total_birds)`` and a species lookup, with the plot order."""
    named = species_totals.join(groups, "species", "left").withColumn("grouping", fold_groups(F.col("grouping")))
    return composition(named, "grouping", "total_birds", k).withColumn(
        "plot_order", factor_code(F.col("grouping"), COMPOSITION_LEVELS)
    )
