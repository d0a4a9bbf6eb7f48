"""Candidate models, AICc ranking and the top model.

Every subset of the terms is fitted exactly; none is screened out. The full model only supplies the
starting point of each subset, so that most subsets need two or three steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywing.operators.count_models import FAMILIES, fit_counts, full_models, prepare
from tallywing.operators.scaling import NEEDS, TERMS, design
from tallywing.session import settle

DELTA_CUT = 4.0


def allowed(mask: Column, terms: Sequence[str], needs: dict[str, str]) -> Column:
    """True for a subset in which each dependent term comes with the term it needs."""
    ok = F.lit(True)
    for term, needed in needs.items():
        if term in terms and needed in terms:
            has = mask.bitwiseAND(1 << terms.index(term)) != 0
            ok = ok & (~has | (mask.bitwiseAND(1 << terms.index(needed)) != 0))
    return ok


def model_space(groups: DataFrame, terms: Sequence[str] = tuple(TERMS), needs: dict[str, str] | None = None) -> DataFrame:
    """All allowed subsets for each row of ``groups``, as bit masks over ``terms``."""
    needs = NEEDS if needs is None else needs
    masks = F.explode(F.sequence(F.lit(0), F.lit((1 << len(terms)) - 1)))
    return groups.withColumn("mask", masks).filter(allowed(F.col("mask"), list(terms), needs))


def aicc(loglik: Column, k: Column, n: Column) -> Column:
    """-2 logLik + 2k + 2k(k+1)/(n-k-1); NULL when there are too few rows for the correction."""
    correction = F.when(n - k - 1 > 0, F.try_divide(2.0 * k * (k + 1), n - k - 1))
    return -2.0 * loglik + 2.0 * k + correction


def rank_models(scores: DataFrame, by: str = "group") -> DataFrame:
    """Add ``delta``, Akaike ``weight``, ``position`` and ``left_out`` within each group.

    Weights are taken over all models with an AICc, before any cut. A model without one (not converged, or with too few
    rows) keeps its row: its delta, weight and position are NULL, and ``left_out`` counts such models of the group. The
    window holds one row per candidate model of a group.
    """
    group = Window.partitionBy(by)
    out = scores.withColumns({
        "delta": F.col("aicc") - F.min("aicc").over(group), "left_out": F.count_if(F.col("aicc").isNull()).over(group)})
    likelihood = F.exp(-F.col("delta") / 2)
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last("aicc"), "model_id")
    return out.withColumns({
        "weight": likelihood / F.sum(likelihood).over(group),
        "position": F.when(F.col("aicc").isNotNull(), F.row_number().over(order)),
    })


def close_models(ranked: DataFrame, cut: float = DELTA_CUT) -> DataFrame:
    return ranked.filter(F.col("delta") < cut)


def top_models(ranked: DataFrame) -> DataFrame:
    return ranked.filter("position = 1")


def scores_of(fits: DataFrame) -> DataFrame:
    """Fits with their AICc, NULL for those that did not converge."""
    return fits.withColumn("aicc", F.when(F.col("converged"), aicc(F.col("loglik"), F.col("k"), F.col("n"))))


def _subset_starts(terms: Sequence[str]):
    """Best guess of each subset's coefficients from the full fit, leaving terms out at their estimate's expense."""
    size = len(terms) + 1

    def starts(batches):
        for pdf in batches:
            guesses = []
            for mask, beta, vcov, log_theta, zeta in zip(pdf["mask"], pdf["beta"], pdf["vcov"], pdf["log_theta"], pdf["zeta"]):
                beta, vcov = np.array(beta, dtype=float), np.array(vcov, dtype=float).reshape(size, size)
                out = [j for j in range(1, size) if not (int(mask) >> (j - 1)) & 1]
                if out:
                    beta = beta - vcov[:, out] @ np.linalg.lstsq(vcov[np.ix_(out, out)], beta[out], rcond=None)[0]
                    beta[out] = 0.0
                guesses.append([*beta, 0.0 if pd.isna(log_theta) else log_theta, 0.0 if pd.isna(zeta) else zeta])
            yield pd.DataFrame({
                "group": pdf["group"], "model_id": pdf["mask"], "family": pdf["family_code"], "mask": pdf["mask"], "start": guesses,
            })

    return starts


def all_subsets(
    frame: DataFrame, family: str, by: str = "species", terms: Sequence[str] = tuple(TERMS), needs: dict[str, str] | None = None
) -> DataFrame:
    """Every allowed subset of the terms, fitted for every group. ``model_id`` is the term mask."""
    terms = list(terms)
    ready = prepare(design(settle(frame, "frame"), by, terms), len(terms))
    full = fit_counts(ready, full_models(ready.moments, [family], len(terms)), [family]).filter("beta is not null")
    start = full.withColumnRenamed("mask", "full_mask").withColumn("family_code", F.lit(FAMILIES[family]))
    schema = "group string, model_id int, family int, mask int, start array<double>"
    candidates = settle(model_space(start, terms, needs).mapInPandas(_subset_starts(terms), schema), "candidates")
    return fit_counts(ready, candidates, [family], covariance=False)


def select_models(frame: DataFrame, family: str, by: str = "species", terms: Sequence[str] = tuple(TERMS)) -> DataFrame:
    """Ranked candidates: AICc, delta and weight of every subset, per group; see ``rank_models`` for those that did not converge."""
    return rank_models(scores_of(all_subsets(frame, family, by, terms)))


def refit_top(frame: DataFrame, ranked: DataFrame, family: str, by: str = "species", terms: Sequence[str] = tuple(TERMS)) -> DataFrame:
    """The top model of each group with its covariance."""
    terms = list(terms)
    chosen = top_models(ranked).select(
        "group", "model_id", F.lit(FAMILIES[family]).alias("family"), "mask", F.lit(None).cast("array<double>").alias("start")
    )
    return fit_counts(prepare(design(frame, by, terms), len(terms)), chosen, [family])


def compare_families(fits: DataFrame) -> DataFrame:
    """AICc table of the Poisson, negative binomial and zero-inflated fits of each group."""
    return rank_models(scores_of(fits))


def term_names(mask: Column, terms: Sequence[str] = tuple(TERMS)) -> Column:
    """Readable formula such as ``doy+doy2+obs_hours``."""
    return F.concat_ws("+", *[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(terms)])
