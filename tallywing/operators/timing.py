"""Migration timing: abundance-weighted mean day and its trend over years.

After the first aggregate the data is one row per species and year; trends are sums of squares and
products per species, added up where a figure is pooled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.functions.special import f_upper_p, student_two_sided_p

Z95 = 1.96


def weighted_mean_day(frame: DataFrame) -> DataFrame:
    """Mean day of year weighted by birds; NULL for a season without any."""
    return frame.groupBy("species", "year").agg(
        ratio(F.sum(F.col("doy") * F.col("birds")), F.sum("birds")).alias("mean_doy")
    )


def with_names(days: DataFrame, names: DataFrame) -> DataFrame:
    """Scientific name as the species label, the code kept beside it."""
    joined = days.join(names.select("species", "sci_name"), "species", "left")
    return joined.select(F.col("sci_name"), F.col("species").alias("code"), "year", "mean_doy")


def species_trends(days: DataFrame, by: str = "species") -> DataFrame:
    """Least-squares line of mean day on year per species, with the sums later steps need."""
    known = days.filter("mean_doy is not null").withColumn("x", F.col("year").cast("double"))
    x, y = F.col("x"), F.col("mean_doy")
    sums = known.groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
    )
    return sums.withColumn("rss", F.col("syy") - F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("sxy"))


#: Bounds of the variance ratio on a log scale, looked at in halves, and halvings about the best of them.
_LOG_RATIO, _HALVINGS = (-30.0, 30.0), 60
#: Year and day that sums are taken about, so that squares keep their digits.
_ORIGIN = (2000.0, 180.0)


def _line(sums: np.ndarray, within: np.ndarray, ratio_: float) -> tuple[float, ...]:
    """Fit at a given ratio of the levels' variance to that of residuals.

    ``sums`` has a row for each number of years: years, species, and the sums over their species of mean x, mean y, and the
    products. A species' mean weighs n / (1 + n ratio) beside what its years say within it.
    """
    n, k, sx, sy, sxx, sxy, syy = sums.T
    w = n / (1 + n * ratio_)
    total = (w * k).sum()
    mean_x, mean_y = (w * sx).sum() / total, (w * sy).sum() / total
    xx = within[0] + (w * (sxx - 2 * mean_x * sx + mean_x**2 * k)).sum()
    xy = within[1] + (w * (sxy - mean_x * sy - mean_y * sx + mean_x * mean_y * k)).sum()
    yy = within[2] + (w * (syy - 2 * mean_y * sy + mean_y**2 * k)).sum()
    slope = xy / xx if xx > 0 else np.nan
    rss = yy - slope * xy
    level = mean_y - slope * mean_x
    squares = syy + level**2 * k + slope**2 * sxx - 2 * level * sy - 2 * slope * sxy + 2 * level * slope * sx
    rows = (n * k).sum()
    score = rows * (w * w * squares).sum() / rss - (w * k).sum() if rss > 0 else -np.inf
    return score, slope, mean_x, mean_y, xx, rss / rows, total


def _most_likely(batches):
    """One row of the maximum-likelihood line from one row of sums: the ratio is where the likelihood's slope in it is 0, or 0."""
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            groups = [[float(g[c]) for c in ("n", "k", "sx", "sy", "sxx", "sxy", "syy")] for g in row["groups"]]
            sums, within = np.array(groups), np.array([row["sxx"], row["sxy"], row["syy"]], float)
            n, k = sums[:, 0], sums[:, 1]

            def likelihood(at: float) -> float:
                return -row["n"] * np.log(_line(sums, within, at)[5]) - (k * np.log1p(n * at)).sum()

            with np.errstate(divide="ignore", invalid="ignore"):  # there may be more than one peak: halve about the highest
                places = np.arange(_LOG_RATIO[0], _LOG_RATIO[1] + 0.25, 0.5)
                values = np.array([likelihood(np.exp(p)) for p in places])
                best = places[int(np.argmax(np.where(np.isnan(values), -np.inf, values)))]
                ratio_, (low, high) = 0.0, (max(best - 0.5, _LOG_RATIO[0]), min(best + 0.5, _LOG_RATIO[1]))
                if best > _LOG_RATIO[0]:
                    for _ in range(_HALVINGS):
                        middle = (low + high) / 2
                        low, high = (middle, high) if _line(sums, within, np.exp(middle))[0] > 0 else (low, middle)
                    ratio_ = float(np.exp((low + high) / 2))
                found = _line(sums, within, ratio_)
            _, slope, mean_x, mean_y, xx, sigma2, total = found
            known = bool(np.isfinite(slope))
            out.append((row["n"], row["species"], row["n"] - row["species"], xx, slope if known else None, sigma2 if known else None,
                        mean_x + _ORIGIN[0], mean_y + _ORIGIN[1], ratio_ * sigma2 if known else None, total))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _POOLED.split(", ")])


_POOLED = ("n bigint, species bigint, df bigint, sxx double, slope double, sigma2 double, mean_x double, mean_y double, levels double, weight double")


def _pooled(trends: DataFrame) -> DataFrame:
    """One row of the pooled line: maximum likelihood of a line with a random level per species, whatever years each has.

    The profile likelihood in the ratio of the two variances needs the sums within species and, for each number of years
    a species can have, sums over its species; so one row with an entry per number of years goes to the search. ``mean_x`` and
    ``mean_y`` are the weighted means, ``weight`` the sum of weights, ``levels`` the variance of levels, ``sigma2`` that of residuals.
    """
    a, b = F.col("mean_x") - F.lit(_ORIGIN[0]), F.col("mean_y") - F.lit(_ORIGIN[1])
    by_years = trends.groupBy("n").agg(
        F.count("*").alias("k"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"),
        F.sum(b * b).alias("syy"), F.sum("sxx").alias("in_xx"), F.sum("sxy").alias("in_xy"), F.sum("syy").alias("in_yy"))
    entry = F.struct("n", "k", "sx", "sy", "sxx", "sxy", "syy")
    one = by_years.agg(
        F.sort_array(F.collect_list(entry)).alias("groups"), F.sum("in_xx").alias("sxx"), F.sum("in_xy").alias("sxy"), F.sum("in_yy").alias("syy"),
        F.sum(F.col("n") * F.col("k")).alias("n"), F.sum("k").alias("species"))
    return one.filter("n is not null").mapInPandas(_most_likely, _POOLED)


def pooled_trend(trends: DataFrame) -> DataFrame:
    """One slope for all species, each with its own random level, with its interval."""
    sums = _pooled(trends).withColumn("se", F.sqrt(ratio(F.col("sigma2"), F.col("sxx"))))
    return sums.withColumns({
        "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
        "lci": F.col("slope") - Z95 * F.col("se"), "uci": F.col("slope") + Z95 * F.col("se"),
    })


def _with_pooled_variance(trends: DataFrame) -> DataFrame:
    """Lines of species seen in two years or more, with the maximum-likelihood residual variance of
    all lines together and its degrees of freedom."""
    lines = trends.filter("sxx > 0")
    sums = lines.agg(ratio(F.sum("rss"), F.sum("n")).alias("sigma2"), (F.sum("n") - 2 * F.count("*") - 1).cast("long").alias("df"))
    whole = sums.select(F.struct("sigma2", "df")).scalar()
    return lines.withColumn("whole", whole).select(*lines.columns, "whole.sigma2", "whole.df")


def slope_tests(trends: DataFrame, by: str = "species") -> DataFrame:
    """Each slope against 0 with the pooled variance; a two-point or flat-year species has none."""
    rows = _with_pooled_variance(trends)
    rows = rows.withColumn("se", F.sqrt(ratio(F.col("sigma2"), F.col("sxx"))))
    rows = rows.withColumn("t_ratio", ratio(F.col("slope"), F.col("se")))
    return rows.select(
        by, F.col("slope").alias("year_trend"), (F.col("slope") - Z95 * F.col("se")).alias("lci"),
        (F.col("slope") + Z95 * F.col("se")).alias("uci"), "se", "df", "t_ratio",
        student_two_sided_p(F.col("t_ratio"), F.col("df")).alias("p_value"),
    )


def predict_all(days: DataFrame, trends: DataFrame, by: str = "species") -> DataFrame:
    """Mean day per year from the pooled trend, with its interval, which holds how far species' levels vary."""
    rows = days.filter("mean_doy is not null").join(trends.select(by), by, "left_semi").select("year").distinct()
    pooled = _pooled(trends)
    rows = rows.withColumn("line", pooled.select(F.struct(*pooled.columns)).scalar()).select("year", "line.*")
    away = F.col("year") - F.col("mean_x")
    se = F.sqrt(F.col("sigma2") * (1 / F.col("weight") + ratio(away * away, F.col("sxx"))))
    return rows.select("year", (F.col("mean_y") + F.col("slope") * away).alias("predicted"), se.alias("se")).select(
        "year", "predicted", (F.col("predicted") - Z95 * F.col("se")).alias("conf_low"),
        (F.col("predicted") + Z95 * F.col("se")).alias("conf_high"),
    )


def predict_species(days: DataFrame, trends: DataFrame, by: str = "species") -> DataFrame:
    """Mean day per species and year from the species' own line, with the pooled variance."""
    lines = _with_pooled_variance(trends)
    rows = days.filter("mean_doy is not null").select(by, "year").distinct().join(lines, by)
    away = F.col("year") - F.col("mean_x")
    se = F.sqrt(F.col("sigma2") * (1 / F.col("n") + away * away / F.col("sxx")))
    rows = rows.select(by, "year", (F.col("mean_y") + F.col("slope") * away).alias("predicted"), se.alias("se"))
    return rows.select(
        by, "year", "predicted", (F.col("predicted") - Z95 * F.col("se")).alias("conf_low"),
        (F.col("predicted") + Z95 * F.col("se")).alias("conf_high"),
    )


def shift(predicted: DataFrame, *by: str) -> DataFrame:
    """Last predicted day minus the first."""
    return predicted.groupBy(*by).agg(
        (F.max_by("predicted", "year") - F.min_by("predicted", "year")).alias("shift")
    )


def equal_variance(days: DataFrame, trends: DataFrame, by: str = "species") -> DataFrame:
    """Brown-Forsythe F of the residuals about each species' line, with its p-value."""
    rows = days.filter("mean_doy is not null").join(trends.filter("sxx > 0").select(by, "slope", "intercept"), by)
    rows = rows.withColumn("r", F.col("mean_doy") - F.col("intercept") - F.col("slope") * F.col("year"))
    spread = rows.join(rows.groupBy(by).agg(F.median("r").alias("middle")), by).withColumn("z", F.abs(F.col("r") - F.col("middle")))
    groups = spread.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("z").alias("zbar"), F.var_pop("z").alias("within")
    )
    sums = groups.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("within")).alias("within"),
        F.sum(F.col("n") * F.col("zbar")).alias("zsum"), F.sum(F.col("n") * F.col("zbar") * F.col("zbar")).alias("zsquares"),
    )
    between = F.col("zsquares") - ratio(F.col("zsum") * F.col("zsum"), F.col("n"))
    top, bottom = ratio(between, F.col("groups") - 1), ratio(F.col("within"), F.col("n") - F.col("groups"))
    tested = sums.select(
        (F.col("groups") - 1).alias("df1"), (F.col("n") - F.col("groups")).alias("df2"), ratio(top, bottom).alias("f")
    )
    return tested.withColumn("p_value", f_upper_p(F.col("f"), F.col("df1"), F.col("df2")))
