"""Fits checked by what a maximum of the likelihood must satisfy.

SQL cannot repeat an iterative fit, but it can state its score equations: at the estimates, the derivative of the
log-likelihood in every coefficient of the model is zero. The Spark side adds the derivative up over all rows, relative to
the sum of its absolute terms; the SQL side says which groups and terms there are and that the figure is 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.functions.special import digamma
from tallywing.operators import count_models as cm
from tallywing.operators import effects as fx
from tallywing.operators import selection
from tallywing.operators.scaling import TERMS
from tallywing.plans.catalog import query
from tallywing.session import settle

_NAMES = ["intercept", *TERMS]
_GROUPS = "(SELECT species, count(*) AS n FROM frame GROUP BY species HAVING sum(birds) > 0)"
_ALL_TERMS = "SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS term"


def _zero(extra: str = "") -> str:
    return f"SELECT species, term, 0.0::DOUBLE AS score FROM {_GROUPS}, ({_ALL_TERMS}{extra})"


def _relative(parts: dict):
    """Sum of each part over the sum of its absolute terms, to four digits; 0 where there is nothing."""
    return [
        F.struct(F.lit(name).alias("term"), (F.round(F.coalesce(F.try_divide(F.sum(p), F.sum(F.abs(p))), F.lit(0.0)), 4) + 0.0).alias("score"))
        for name, p in parts.items()]


def _scores(rows, weight, extra: dict | None = None, mask=None):
    """Long table (species, term, score) of the derivative ``weight * x`` of every coefficient; terms outside ``mask`` count 0."""
    x = {"intercept": F.lit(1.0), **{t: F.col(f"z_{t}") for t in TERMS}}
    if mask is not None:
        x = {n: v if i == 0 else F.when(mask.bitwiseAND(1 << (i - 1)) != 0, v).otherwise(0.0) for i, (n, v) in enumerate(x.items())}
    parts = {name: weight * value for name, value in x.items()} | (extra or {})
    summed = rows.groupBy("species").agg(F.array(*_relative(parts)).alias("s"))
    return summed.select("species", F.explode("s").alias("s")).select("species", "s.term", "s.score")


def _count_weight():
    """Derivative of the negative binomial log-likelihood in the linear predictor."""
    return (F.col("birds") - F.col("mu")) / (1 + F.col("mu") / F.col("theta"))


def _theta_score():
    y, mu, theta = F.col("birds"), F.col("mu"), F.col("theta")
    return digamma(y + theta) - digamma(theta) + F.log(theta) + 1 - F.log(theta + mu) - (y + theta) / (theta + mu)


@query("score_poisson", _zero(), ("frame",))
def score_poisson(t):
    return _scores(fx.with_fit(t.scaled, cm.fit_full(t.stored_frame, ["poisson"])), F.col("birds") - F.col("mu"))


@query("score_nb2", _zero(" UNION ALL SELECT 'theta'"), ("frame",))
def score_nb2(t):
    return _scores(fx.with_fit(t.scaled, cm.fit_full(t.stored_frame, ["nbinom"])), _count_weight(), {"theta": _theta_score()})


@query("score_zinb", _zero(" UNION ALL SELECT 'zero'"), ("frame",))
def score_zinb(t):
    """A zero is of the zero part with probability 1 - (1 - pi) f0 / p_zero, and counts in the count part with the rest."""
    birds, pi = F.col("birds"), F.col("pi")
    zero_part = F.when(birds > 0, 0.0).otherwise(pi / F.col("p_zero"))
    rows = fx.with_fit(t.scaled, cm.fit_full(t.stored_frame, ["nbinom+zi"]))
    return _scores(rows, (1 - zero_part) * _count_weight(), {"zero": zero_part - pi})


@query("score_top_model", _zero(), ("frame",))
def score_top_model(t):
    """The selected model of each species, fitted again: score equations of its terms, and 0 for those it lacks."""
    ranked = settle(selection.select_models(t.frame, "nbinom"), "ranked")
    fits = selection.refit_top(t.stored_frame, ranked, "nbinom")
    return _scores(fx.with_fit(t.scaled, fits), _count_weight(), mask=F.col("mask"))


@query("selection_facts", f"""
    SELECT species, n, 384::BIGINT AS models, 2 AS least_k, 11 AS most_k, 1.0::DOUBLE AS weight, 0.0::DOUBLE AS least_delta, true AS ordered
    FROM {_GROUPS}""", ("frame",))
def selection_facts(t):
    """Every allowed subset is ranked: their number, sizes, weights that sum to 1, and positions in order of AICc."""
    ranked = selection.select_models(t.frame, "nbinom")
    return ranked.groupBy(F.col("group").alias("species")).agg(
        F.max("n").alias("n"), F.count("*").alias("models"), F.min("k").alias("least_k"), F.max("k").alias("most_k"),
        F.round(F.sum("weight"), 6).alias("weight"), F.min("delta").alias("least_delta"),
        (F.sort_array(F.collect_list(F.struct("position", "aicc")))["aicc"] == F.sort_array(F.collect_list("aicc"))).alias("ordered"))


@query("family_facts", f"""
    SELECT species, n, family, k, 1.0::DOUBLE AS weight, 0.0::DOUBLE AS least_delta
    FROM {_GROUPS}, (SELECT unnest([{{'family': 'poisson', 'k': 10}}, {{'family': 'nbinom', 'k': 11}}, {{'family': 'nbinom+zi', 'k': 12}}], recursive := true))""",
       ("frame",))
def family_facts(t):
    ranked = settle(selection.compare_families(cm.fit_full(t.stored_frame, ["poisson", "nbinom", "nbinom+zi"])), "families")
    sums = ranked.groupBy("group").agg(F.round(F.sum("weight"), 6).alias("weight"), F.min("delta").alias("least_delta"))
    return ranked.select("group", "n", "family", "k").join(sums, "group").withColumnRenamed("group", "species")
