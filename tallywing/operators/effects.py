"""Effects of fitted models: average marginal effects, predictions over one term, printed tables.

``frame`` is a model frame with standardised terms (see ``scaling.with_terms``), ``fits`` the result
of a fit. Sums over rows run as one aggregate per call; only the last step, a small quadratic form
per group, is numpy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numbers import effect_text
from tallywing.operators.scaling import TERMS

Z95 = 1.96


def linear_predictor(terms: Sequence[str]) -> Column:
    eta = F.get("beta", 0)
    for i, term in enumerate(terms):
        eta = eta + F.get("beta", i + 1) * F.col(f"z_{term}")
    return eta


def with_fit(frame: DataFrame, fits: DataFrame, terms: Sequence[str] = tuple(TERMS), by: str = "species") -> DataFrame:
    """Frame rows with ``mu`` (mean of the count part), ``mean``, ``variance`` and ``p_zero``.

    Written in the JVM; the fits are a few rows per group and join by their true size.
    """
    family = F.col("family")
    params = fits.filter("beta is not null").select(
        F.col("group").alias(by), "family", "k", "mask", "beta", F.exp("log_theta").alias("theta"),
        F.coalesce(1 / (1 + F.exp(-F.col("zeta"))), F.lit(0.0)).alias("pi"),
    )
    rows = frame.join(params, by).withColumn("mu", F.exp(linear_predictor(terms)))
    mu, theta, pi = F.col("mu"), F.col("theta"), F.col("pi")
    spread = F.when(family == "poisson", mu).otherwise(mu + mu * mu / theta)
    none = F.when(family == "poisson", F.exp(-mu)).otherwise(F.exp(theta * (F.log(theta) - F.log(theta + mu))))
    return rows.withColumns({
        "mean": (1 - pi) * mu, "variance": (1 - pi) * spread + pi * (1 - pi) * mu * mu, "p_zero": pi + (1 - pi) * none,
    })


def marginal_effects(frame: DataFrame, fits: DataFrame, terms: Sequence[str] = tuple(TERMS), by: str = "species") -> DataFrame:
    """Average change of the expected count per unit of each raw term, with a delta-method interval.

    ``doy`` combines its linear and squared term. Terms a model lacks give no row.
    """
    terms = list(terms)
    size = len(terms) + 1
    x = [F.lit(1.0), *[F.col(f"z_{t}") for t in terms]]
    curved = "doy" in terms and "doy2" in terms
    sums = [F.avg(F.col("mean") * x[j]).alias(f"m{j}") for j in range(size)]
    if curved:
        sums += [F.avg(F.col("mean") * F.col("z_doy") * x[j]).alias(f"d{j}") for j in range(size)]
    plain = [t for t in terms if t != "doy2"]
    sums += [F.first(f"sd_{t}").alias(f"sd_{t}") for t in plain]
    means = with_fit(frame, fits, terms, by).groupBy(by).agg(*sums)
    joined = means.join(fits.select(F.col("group").alias(by), "mask", "beta", "vcov"), by)

    def effects(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                beta, vcov = np.asarray(row.beta, float), np.asarray(row.vcov, float).reshape(size, size)
                m = np.array([getattr(row, f"m{j}") for j in range(size)])
                for term in plain:
                    j = terms.index(term) + 1
                    has = (row.mask >> (j - 1)) & 1
                    sd = getattr(row, f"sd_{term}")
                    if not has or not sd:
                        continue
                    unit = np.zeros(size)
                    unit[j] = m[0]
                    value, slope = beta[j] * m[0], beta[j] * m + unit
                    if curved and term == "doy":
                        q = terms.index("doy2") + 1
                        d = np.array([getattr(row, f"d{k}") for k in range(size)])
                        value, slope = value + 2 * beta[q] * m[j], slope + 2 * beta[q] * d
                        slope[q] += 2 * m[j]
                    se = float(np.sqrt(max(slope @ vcov @ slope, 0.0))) / sd
                    out.append((getattr(row, by), term, value / sd, value / sd - Z95 * se, value / sd + Z95 * se))
            yield pd.DataFrame(out, columns=[by, "term", "estimate", "conf_low", "conf_high"])

    return joined.mapInPandas(effects, f"{by} string, term string, estimate double, conf_low double, conf_high double")


def predict_grid(frame: DataFrame, fits: DataFrame, term: str, terms: Sequence[str] = tuple(TERMS), by: str = "species") -> DataFrame:
    """Predicted count over the observed values of one term, the other terms at their mean."""
    terms = list(terms)
    size, j = len(terms) + 1, terms.index(term) + 1
    grid = frame.select(by, F.col(term).cast("double").alias("value"), F.col(f"z_{term}").alias("z")).distinct()
    chosen = fits.select(F.col("group").alias(by), "beta", "vcov")
    places = [(0, F.lit(1.0)), (j, F.col("z"))]
    if term == "doy" and "doy2" in terms:
        places.append((terms.index("doy2") + 1, F.col("z") * F.col("z")))
    eta, var = F.lit(0.0), F.lit(0.0)
    for a, xa in places:
        eta = eta + F.get("beta", a) * xa
        for b, xb in places:
            var = var + xa * xb * F.get("vcov", a * size + b)
    rows = grid.join(chosen, by).select(by, "value", eta.alias("eta"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))
    return rows.select(
        by, "value", F.exp("eta").alias("predicted"), F.exp(F.col("eta") - Z95 * F.col("se")).alias("conf_low"),
        F.exp(F.col("eta") + Z95 * F.col("se")).alias("conf_high"),
    )


# Column order of the printed effects table.
TABLE_TERMS = ["year", "doy", "obs_hours", "tsm", "wind_speed", "wind_dir_cos", "wind_dir_sin", "pressure"]


def pivot_terms(effects: DataFrame, value: str, terms: Sequence[str] = tuple(TABLE_TERMS), by: str = "species") -> DataFrame:
    """A column per term, NULL where a model lacks it."""
    return effects.groupBy(by).pivot("term", list(terms)).agg(F.first(value)).select(by, *terms)


def effects_table(effects: DataFrame, pooled: DataFrame | None = None, by: str = "species") -> DataFrame:
    """Printed table of ``est (lo to hi)``, species first and the pooled row below; columns in fixed order."""
    def table(rows: DataFrame) -> DataFrame:
        text = effect_text(F.col("estimate"), F.col("conf_low"), F.col("conf_high"))
        return pivot_terms(rows.select(by, "term", text.alias("effect")), "effect", by=by)

    return table(effects) if pooled is None else table(effects).unionByName(table(pooled), allowMissingColumns=True)
