"""Standardised covariates and the design matrix.

Means and deviations are taken over the complete cases of each group, as an aggregate joined back. A
window over the group would send every row of the largest group to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.session import settle

# The nine terms of the full model; doy2 is the square of standardised doy and needs it.
TERMS = ["year", "tsm", "doy", "doy2", "pressure", "wind_speed", "wind_dir_cos", "wind_dir_sin", "obs_hours"]
NEEDS = {"doy2": "doy"}


def scale_stats(frame: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    return frame.groupBy(by).agg(*[
        f(c).alias(f"{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ])


def standardise(frame: DataFrame, columns: Sequence[str], by: str = "species", prefix: str = "z_") -> DataFrame:
    """Add ``z_<column>`` = (x - mean) / sample sd per group, NULL where a group does not vary.

    The statistics are settled first, so the join sees how small they are and the frame stays put.
    """
    stats = settle(scale_stats(frame, columns, by), "scale")
    scaled = {prefix + c: ratio(F.col(c) - F.col(f"mean_{c}"), F.col(f"sd_{c}")) for c in columns}
    return frame.join(stats, by).withColumns(scaled)


def with_terms(frame: DataFrame, by: str = "species", terms: Sequence[str] = tuple(TERMS)) -> DataFrame:
    """Frame with ``z_<term>`` for every model term and the group's ``sd_<term>``; a flat term is 0."""
    plain = [t for t in terms if t != "doy2"]
    out = standardise(frame, plain, by)
    out = out.withColumns({f"z_{t}": F.coalesce(f"z_{t}", F.lit(0.0)) for t in plain})
    return out.withColumn("z_doy2", F.col("z_doy") * F.col("z_doy")) if "doy2" in terms else out


def design(frame: DataFrame, by: str = "species", terms: Sequence[str] = tuple(TERMS), keep: Sequence[str] = ()) -> DataFrame:
    """``(group, y, x1 .. xp)`` ready for fitting, and the columns ``keep``."""
    scaled = with_terms(frame, by, terms)
    return scaled.select(
        F.col(by).cast("string").alias("group"), F.col("birds").cast("double").alias("y"),
        *[F.col(f"z_{t}").alias(f"x{i + 1}") for i, t in enumerate(terms)], *keep,
    )


def gram(df: DataFrame, columns: Sequence[str], by: str, weight: str | None = None) -> DataFrame:
    """All pairwise sums of products per group, in one pass of partial sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [
        F.sum(w * F.col(a) * F.col(b)).alias(f"{a}__{b}")
        for i, a in enumerate(columns) for b in columns[i:]
    ]
    return df.groupBy(by).agg(F.count("*").alias("n"), *sums)
