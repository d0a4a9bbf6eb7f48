"""Fits with random effects, checked by what a maximum of their likelihood must satisfy; see ``score_queries``.

At the mode of the effects the derivative of the likelihood in each of them is 0, and at the maximum of the Laplace
likelihood so is its derivative in every coefficient and, inside their bounds, in the variances. The Spark side adds these
up over all rows by column expressions, apart from the sums of the fit; the SQL side says which levels and terms there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.operators import effects as fx
from tallywing.operators import mixed_models as mm
from tallywing.operators.scaling import TERMS, with_terms
from tallywing.plans.catalog import query
from tallywing.session import settle

_NAMES = ["intercept", *TERMS]
_FAMILIES = ["poisson", "nbinom"]
_GROUPS = "(SELECT species FROM frame GROUP BY species HAVING sum(birds) > 0)"
_LEVELS = "(SELECT species, observer AS term FROM frame GROUP BY species, observer HAVING species IN (SELECT species FROM g))"


def _fitted(frame: DataFrame, randoms, families=("nbinom",), by: str = "species") -> tuple[DataFrame, DataFrame]:
    """Fits, and the effect of each level of each random term."""
    ready = mm.prepare(frame, randoms, by)
    fits = settle(mm.fit(ready, mm.full_models(ready, families), families), "mixed")
    return fits, settle(mm.effects_by_level(fits, ready), "effects")


def _of(effects: DataFrame, term: str, by: str, level: str, *names: str) -> DataFrame:
    named = [F.col(n).alias(m) for n, m in zip(("effect", "slope"), names)]
    return effects.filter(F.col("term") == term).select(F.col("group").alias(by), "family", F.col("level").alias(level), *named)


def _score(total: Column, size: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(total, size), F.lit(0.0)), 4) + 0.0


def _derivatives(rows: DataFrame) -> DataFrame:
    """First to third derivatives of each row's likelihood in the linear predictor, as ``s``, ``h`` and ``t``."""
    y, mu, theta, poisson = F.col("birds"), F.col("mu"), F.col("theta"), F.col("family") == "poisson"
    room = theta + mu
    return rows.withColumns({
        "s": F.when(poisson, y - mu).otherwise(theta * (y - mu) / room),
        "h": F.when(poisson, -mu).otherwise(-(y + theta) * mu * theta / (room * room)),
        "t": F.when(poisson, -mu).otherwise(-(y + theta) * theta * mu * (theta - mu) / (room * room * room)),
    })


def _total(c: Column, name: str) -> list[Column]:
    return [F.sum(c).alias(name), F.sum(F.abs(c)).alias(f"{name}_size")]


@query("score_observer", f"""WITH g AS {_GROUPS}
    SELECT species, family, term, 0.0::DOUBLE AS score
    FROM (SELECT * FROM {_LEVELS} UNION ALL SELECT species, unnest([{", ".join(f"'{n}'" for n in [*_NAMES, "log_sd"])}]) FROM g),
         (SELECT unnest(['poisson', 'nbinom']) AS family)""", ("frame",))
def score_observer(t):
    """An effect of each observer, for every species and family: equations of levels, coefficients and the variance."""
    fits, effects = _fitted(t.stored_frame, [mm.OBSERVER], _FAMILIES)
    rows = fx.with_fit(t.scaled, fits).join(_of(effects, "observer", "species", "observer", "b"), ["species", "family", "observer"])
    rows = _derivatives(rows.withColumn("mu", F.col("mu") * F.exp("b")))
    sums = [e for j, x in enumerate([F.lit(1.0), *[F.col(f"z_{t}") for t in TERMS]]) for e in (*_total(F.col("s") * x, f"s{j}"), F.sum(F.col("t") * x).alias(f"t{j}"), F.sum(F.col("h") * x).alias(f"h{j}"))]
    levels = rows.groupBy("species", "family", "observer").agg(F.first("b").alias("b"), *sums)
    sd = fits.select(F.col("group").alias("species"), "family", F.get("variances", 0).alias("log_sd"))
    levels = settle(levels.join(sd, ["species", "family"]).withColumn("p", F.exp(-2 * F.col("log_sd"))).withColumn("d", F.col("p") - F.col("h0")), "levels")
    b, p, d = F.col("b"), F.col("p"), F.col("d")
    of_levels = levels.select("species", "family", F.col("observer").alias("term"), _score(F.col("s0") - b * p, F.col("s0_size") + F.abs(b * p)).alias("score"))
    of_terms = [(F.sum(F.col(f"s{j}") + (F.col(f"t{j}") + F.col("t0") * F.col(f"h{j}") / d) / d / 2), F.sum(f"s{j}_size")) for j in range(len(_NAMES))]
    of_sd = F.sum(b * b * p - 1 + p / d + F.col("t0") * b * p / (d * d))
    at_bound = (F.first("log_sd") <= mm.LOG_SD_RANGE[0]) & (of_sd <= 0)
    parts = [F.struct(F.lit(n).alias("term"), _score(*x).alias("score")) for n, x in zip(_NAMES, of_terms)]
    parts.append(F.struct(F.lit("log_sd").alias("term"), F.when(at_bound, 0.0).otherwise(_score(of_sd, F.sum(b * b * p) + F.count("*"))).alias("score")))
    of_models = levels.groupBy("species", "family").agg(F.array(*parts).alias("s")).select("species", "family", F.explode("s").alias("s"))
    return of_levels.unionByName(of_models.select("species", "family", "s.term", "s.score"))


@query("score_pooled", """
    SELECT observer AS level, 'observer' AS term, 0.0::DOUBLE AS score FROM frame GROUP BY observer
    UNION ALL SELECT species, unnest(['level', 'slope']), 0.0::DOUBLE FROM frame GROUP BY species""", ("frame",))
def score_pooled(t):
    """All species in one model, each with its own line over the years, and an effect of each observer: the equations of all effects."""
    frame = settle(t.stored_frame.withColumn("everything", F.lit("all")), "everything")
    fits, effects = _fitted(frame, [mm.OBSERVER, mm.SPECIES_LINES], by="everything")
    rows = fx.with_fit(with_terms(frame, "everything"), fits, by="everything")
    rows = rows.join(_of(effects, "observer", "everything", "observer", "b"), ["everything", "family", "observer"])
    rows = rows.join(_of(effects, "species", "everything", "species", "u", "v"), ["everything", "family", "species"])
    rows = settle(_derivatives(rows.withColumn("mu", F.col("mu") * F.exp(F.col("b") + F.col("u") + F.col("v") * F.col("z_year")))).select(
        "observer", "species", "b", "u", "v", "z_year", "s"), "rows")
    names = ("sd_o", "sd_u", "sd_v", "atanh_r")
    params = fits.select(F.struct(*[F.get("variances", k).alias(n) for k, n in enumerate(names)])).scalar()
    of_observers = rows.groupBy("observer").agg(F.first("b").alias("b"), *_total(F.col("s"), "s")).withColumn("p", params)
    pull = F.col("b") * F.exp(-2 * F.col("p.sd_o"))
    of_observers = of_observers.select(
        F.col("observer").alias("level"), F.lit("observer").alias("term"), _score(F.col("s") - pull, F.col("s_size") + F.abs(pull)).alias("score"))
    r, su, sv, u, v = F.tanh("p.atanh_r"), F.exp("p.sd_u"), F.exp("p.sd_v"), F.col("u"), F.col("v")
    lines = rows.groupBy("species").agg(
        F.first("u").alias("u"), F.first("v").alias("v"), *_total(F.col("s"), "s"), *_total(F.col("s") * F.col("z_year"), "sy")).withColumn("p", params)
    pull_u, pull_v = (u / su - r * v / sv) / su / (1 - r * r), (v / sv - r * u / su) / sv / (1 - r * r)
    parts = F.array(*[F.struct(F.lit(n).alias("term"), _score(F.col(c) - q, F.col(f"{c}_size") + F.abs(q)).alias("score"))
                      for n, c, q in (("level", "s", pull_u), ("slope", "sy", pull_v))])
    of_lines = lines.select(F.col("species").alias("level"), F.explode(parts).alias("p")).select("level", "p.term", "p.score")
    return of_observers.unionByName(of_lines)
