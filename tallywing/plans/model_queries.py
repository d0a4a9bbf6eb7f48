"""Model frames, fits, selection, effects and diagnostics.

Effects and diagnostics are checked exactly at given coefficients. Fits are iterative, so plain SQL
cannot repeat them; two of their consequences can be checked: a Poisson fit reproduces the sums of
every covariate (``glm_poisson_moments``), and with one two-valued covariate the coefficients have a
closed form (``glm_poisson_factor``, ``glm_nb2_factor``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.functions.special import log_gamma
from tallywing.operators import count_models as cm
from tallywing.operators import diagnostics as dg
from tallywing.operators import effects as fx
from tallywing.operators import linear, scaling, selection
from tallywing.operators.panel import MODEL_KEYS
from tallywing.operators.scaling import TERMS
from tallywing.operators.summary import daily_rate
from tallywing.plans.catalog import query
from tallywing.plans.standins import ETA_SQL
from tallywing.session import settle

X = ["1", *[f"z_{t}" for t in TERMS]]


def r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _fitted_given(t):
    return fx.with_fit(t.scaled, t.given)


@query("model_frame", f"SELECT {', '.join(MODEL_KEYS[:3])}, round(tsm, 6) AS tsm, species, total_obs_mins, round(obs_hours, 6) AS obs_hours, "
       "round(wind_speed, 6) AS wind_speed, round(wind_dir_cos, 6) AS wind_dir_cos, round(wind_dir_sin, 6) AS wind_dir_sin, pressure, "
       "observer, birds FROM frame", ("frame",), dates=("date",))
def model_frame(t):
    return r(t.frame, 6, "tsm", "obs_hours", "wind_speed", "wind_dir_cos", "wind_dir_sin")


@query("standardise", "SELECT species, date, " + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in ("year", "doy", "obs_hours")) + " FROM scaled",
       ("scaled",), dates=("date",))
def standardise(t):
    names = ["year", "doy", "obs_hours"]
    rows = scaling.standardise(t.stored_frame, names)
    return r(rows, 6, *[f"z_{c}" for c in names]).select("species", "date", *[f"z_{c}" for c in names])


@query("design_matrix", "SELECT species, date, " + ", ".join(f"round(z_{c}, 6) AS z_{c}" for c in TERMS) + ", birds FROM scaled",
       ("scaled",), dates=("date",))
def design_matrix(t):
    return r(t.scaled, 6, *[f"z_{c}" for c in TERMS]).select("species", "date", *[f"z_{c}" for c in TERMS], "birds")


_PAIRS = [(a, b) for i, a in enumerate(TERMS) for b in TERMS[i:]]


@query("gram_matrix", "SELECT species, count(*) AS n, " + ", ".join(
    f"round(sum(z_{a} * z_{b}), 4) + 0.0 AS z_{a}__z_{b}" for a, b in _PAIRS) + " FROM scaled GROUP BY species", ("scaled",))
def gram_matrix(t):
    sums = scaling.gram(t.scaled, [f"z_{c}" for c in TERMS], "species")
    return sums.withColumns({f"z_{a}__z_{b}": F.round(f"z_{a}__z_{b}", 4) + 0.0 for a, b in _PAIRS})


@query("null_model", """
    SELECT species, count(*) AS n, round(ln(avg(birds)), 6) AS intercept, round(1 / sqrt(sum(birds)), 6) AS se,
           round(sum(birds * m - exp(m) - lgamma(birds + 1)), 3) AS loglik
    FROM (SELECT *, ln(avg(birds) OVER (PARTITION BY species)) AS m FROM frame
          QUALIFY sum(birds) OVER (PARTITION BY species) > 0) GROUP BY species""", ("frame",))
def null_model(t):
    return r(r(dg.null_model(t.frame), 6, "intercept", "se"), 3, "loglik")


@query("glm_poisson")
def glm_poisson(t):
    fits = cm.fit_full(t.frame, ["poisson"])
    return cm.coefficients(fits, TERMS).select("group", "term", "estimate", "se", "z")


@query("glm_poisson_moments", " UNION ALL ".join(
    f"SELECT species, '{name}' AS term, round(sum(birds * {x}), 3) + 0.0 AS total FROM scaled GROUP BY species HAVING sum(birds) > 0"
    for name, x in zip(["intercept", *TERMS], X)), ("scaled",))
def glm_poisson_moments(t):
    """Fitted sums of every covariate; at the maximum they equal the observed sums."""
    table = settle(t.scaled, "scaled")
    design = table.select(F.col("species").alias("group"), F.col("birds").alias("y"), *[
        F.col(f"z_{c}").alias(f"x{i + 1}") for i, c in enumerate(TERMS)])
    ready = cm.prepare(design, len(TERMS))
    fits = cm.fit_counts(ready, cm.full_models(ready.moments, ["poisson"], len(TERMS)), ["poisson"])
    names = ["intercept", *TERMS]
    columns = [F.lit(1.0), *[F.col(f"z_{c}") for c in TERMS]]
    sums = fx.with_fit(table, fits).groupBy("species").agg(*[F.sum(F.col("mean") * x).alias(n) for n, x in zip(names, columns)])
    return r(sums.unpivot("species", names, "term", "total"), 3, "total").withColumn("total", F.col("total") + 0.0)


_WEEKEND = "CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END"


def _weekend_fit(t, family):
    """Fit on one two-valued covariate, through the same Newton steps as any other fit."""
    weekend = F.dayofweek("date").isin(1, 7).cast("double")
    ready = cm.prepare(t.frame.select(F.col("species").alias("group"), F.col("birds").alias("y"), weekend.alias("x1")), 1)
    fits = cm.fit_counts(ready, cm.full_models(ready.moments, [family], 1), [family])
    return r(cm.coefficients(fits, ["weekend"]), 5, "estimate", "se")


@query("glm_poisson_factor", f"""WITH
    s AS (SELECT species, {_WEEKEND} AS x, sum(birds) AS total, avg(birds) AS mean FROM frame GROUP BY ALL),
    w AS (SELECT species, max(CASE WHEN x = 0 THEN total END) AS t0, max(CASE WHEN x = 0 THEN mean END) AS m0,
                 max(CASE WHEN x = 1 THEN total END) AS t1, max(CASE WHEN x = 1 THEN mean END) AS m1 FROM s GROUP BY species)
    SELECT species, 'intercept' AS term, round(ln(m0), 5) AS estimate, round(1 / sqrt(t0), 5) AS se FROM w
    UNION ALL
    SELECT species, 'weekend', round(ln(m1) - ln(m0), 5), round(sqrt(1 / t0 + 1 / t1), 5) FROM w""", ("frame",))
def glm_poisson_factor(t):
    return _weekend_fit(t, "poisson").select(F.col("group").alias("species"), "term", "estimate", "se")


@query("glm_nb2_factor", f"""WITH
    s AS (SELECT species, {_WEEKEND} AS x, avg(birds) AS mean FROM frame GROUP BY ALL),
    w AS (SELECT species, max(CASE WHEN x = 0 THEN mean END) AS m0, max(CASE WHEN x = 1 THEN mean END) AS m1 FROM s GROUP BY species)
    SELECT species, 'intercept' AS term, round(ln(m0), 5) AS estimate FROM w
    UNION ALL
    SELECT species, 'weekend', round(ln(m1) - ln(m0), 5) FROM w""", ("frame",))
def glm_nb2_factor(t):
    """Negative binomial: whatever theta is, each class is fitted at its own mean."""
    return _weekend_fit(t, "nbinom").select(F.col("group").alias("species"), "term", "estimate")


@query("glm_nb2")
def glm_nb2(t):
    fits = cm.fit_full(t.frame, ["nbinom"])
    theta = fits.select("group", F.exp("log_theta").alias("theta"), "loglik", "converged")
    return cm.coefficients(fits, TERMS).select("group", "term", "estimate", "se").join(theta, "group")


@query("glm_zinb")
def glm_zinb(t):
    fits = cm.fit_full(t.frame, ["nbinom+zi"])
    extra = fits.select("group", F.exp("log_theta").alias("theta"), (1 / (1 + F.exp(-F.col("zeta")))).alias("extra_zeros"), "loglik", "converged")
    return cm.coefficients(fits, TERMS).select("group", "term", "estimate", "se").join(extra, "group")


@query("coef_table")
def coef_table(t):
    return cm.coefficient_table(cm.fit_full(t.frame, ["nbinom"]), TERMS)


@query("family_aicc")
def family_aicc(t):
    ranked = selection.compare_families(cm.fit_full(t.frame, ["poisson", "nbinom", "nbinom+zi"]))
    return ranked.select("group", "family", "k", "n", "loglik", "aicc", "delta", "weight", "position")


@query("pooled_fit")
def pooled_fit(t):
    """All species in one model, standardised over the whole frame."""
    frame = t.frame.withColumn("everything", F.lit("All seabirds"))
    fits = cm.fit_full(frame, ["nbinom"], by="everything")
    return cm.coefficient_table(fits, TERMS)


@query("nb_loglik", """
    SELECT species, n, round(sum(lgamma(birds + theta) - lgamma(theta) - lgamma(birds + 1) + theta * (ln(theta) - ln(theta + mu))
                                 + birds * (ln(mu) - ln(theta + mu))), 3) AS loglik
    FROM fitted GROUP BY species, n""", ("fitted",))
def nb_loglik(t):
    return r(dg.log_likelihood(_fitted_given(t)), 3, "loglik").select("species", "n", "loglik")


@query("aicc_score", """
    SELECT species, k, n, round(-2 * loglik + 2 * k + 2 * k * (k + 1) / (n - k - 1), 2) AS aicc
    FROM (SELECT species, 11 AS k, n, sum(lgamma(birds + theta) - lgamma(theta) - lgamma(birds + 1) + theta * (ln(theta) - ln(theta + mu))
                 + birds * (ln(mu) - ln(theta + mu))) AS loglik FROM fitted GROUP BY species, n)""", ("fitted",))
def aicc_score(t):
    scored = dg.log_likelihood(_fitted_given(t))
    return scored.select("species", "k", "n", F.round(selection.aicc(F.col("loglik"), F.col("k"), F.col("n")), 2).alias("aicc"))


_SPACE = """(SELECT species, n, CAST(mask AS INTEGER) AS mask FROM (SELECT species, count(*) AS n FROM frame GROUP BY species),
             (SELECT unnest(range(0, 512)) AS mask) WHERE mask & 8 = 0 OR mask & 4 <> 0)"""


@query("model_space", f"""
    SELECT species, mask, CAST(2 + bit_count(mask) AS INTEGER) AS k,
           round(2.0::DOUBLE * (2 + bit_count(mask)) * (3 + bit_count(mask)) / nullif(greatest(n - 3 - bit_count(mask), 0), 0), 6) AS correction
    FROM {_SPACE}""", ("frame",))
def model_space(t):
    """Candidates of every species and the small-sample correction each would carry."""
    k = (2 + F.bit_count("mask")).cast("int")
    space = selection.model_space(t.frame.groupBy("species").agg(F.count("*").alias("n")))
    room = F.when(F.col("n") - k - 1 > 0, F.col("n") - k - 1)
    return space.select("species", "mask", k.alias("k"), F.round(2.0 * k * (k + 1) / room, 6).alias("correction"))


_WEIGHT_SCORES = """
    SELECT species, month(date) AS model_id, ln(1 + sum(birds)) * 4 AS aicc FROM panel GROUP BY ALL"""
_RANKED = f"""rk AS (SELECT species, CAST(model_id AS INTEGER) AS model_id, round(aicc, 6) AS aicc,
        aicc - min(aicc) OVER (PARTITION BY species) AS delta,
        exp(-(aicc - min(aicc) OVER (PARTITION BY species)) / 2) AS l,
        CAST(row_number() OVER (PARTITION BY species ORDER BY aicc, model_id) AS INTEGER) AS position FROM ({_WEIGHT_SCORES})),
    wt AS (SELECT *, l / sum(l) OVER (PARTITION BY species) AS weight FROM rk)"""


def _ranked_scores(t):
    """Scores made from monthly totals, so that ranking has an exact counterpart."""
    scores = t.panel.groupBy("species", F.month("date").alias("model_id")).agg((F.log1p(F.sum("birds")) * 4).alias("aicc"))
    return selection.rank_models(scores, "species")


@query("aicc_rank", f"""WITH {_RANKED}
    SELECT species, model_id, aicc, round(delta, 6) AS delta, round(weight, 6) AS weight, position FROM wt WHERE delta < 4""", ("panel",))
def aicc_rank(t):
    close = selection.close_models(_ranked_scores(t))
    return r(close, 6, "aicc", "delta", "weight").select("species", "model_id", "aicc", "delta", "weight", "position")


@query("top_model", f"WITH {_RANKED} SELECT species, model_id, aicc, round(weight, 6) AS weight FROM wt WHERE position = 1", ("panel",))
def top_model(t):
    return r(selection.top_models(_ranked_scores(t)), 6, "aicc", "weight").select("species", "model_id", "aicc", "weight")


@query("model_selection")
def model_selection(t):
    """Every subset of the terms fitted for every species; the models within 4 AICc of the best."""
    ranked = selection.select_models(t.frame, "nbinom")
    close = selection.close_models(ranked).withColumn("formula", selection.term_names(F.col("mask")))
    return close.select("group", "formula", "k", "n", "loglik", "aicc", "delta", "weight", "position")


@query("predict_grid", """
    SELECT DISTINCT species, CAST(year AS DOUBLE) AS value, round(exp(b0 + b1 * z_year), 4) AS predicted,
           round(exp(b0 + b1 * z_year - 1.96 * sqrt(v0 + z_year * z_year * v1)), 4) AS conf_low,
           round(exp(b0 + b1 * z_year + 1.96 * sqrt(v0 + z_year * z_year * v1)), 4) AS conf_high
    FROM fitted""", ("fitted",))
def predict_grid(t):
    return r(fx.predict_grid(t.scaled, t.given, "year"), 4, "predicted", "conf_low", "conf_high")


@query("predict_grid_doy", """
    SELECT DISTINCT species, CAST(doy AS DOUBLE) AS value, round(exp(b0 + b3 * z_doy + b4 * z_doy2), 4) AS predicted,
           round(exp(b0 + b3 * z_doy + b4 * z_doy2 - 1.96 * sqrt(v0 + z_doy * z_doy * v3 + z_doy2 * z_doy2 * v4)), 4) AS conf_low,
           round(exp(b0 + b3 * z_doy + b4 * z_doy2 + 1.96 * sqrt(v0 + z_doy * z_doy * v3 + z_doy2 * z_doy2 * v4)), 4) AS conf_high
    FROM fitted""", ("fitted",))
def predict_grid_doy(t):
    return r(fx.predict_grid(t.scaled, t.given, "doy"), 4, "predicted", "conf_low", "conf_high")


def _ame_sql(term: str) -> str:
    j = TERMS.index(term) + 1
    value, slopes = f"b{j} * m0", [f"(b{j} * m{k}" + (" + m0" if k == j else "") for k in range(10)]
    if term == "doy":
        q = TERMS.index("doy2") + 1
        value = f"b{j} * m0 + 2 * b{q} * m{j}"
        slopes = [s + f" + 2 * b{q} * d{k}" + (f" + 2 * m{j}" if k == q else "") for k, s in enumerate(slopes)]
    var = " + ".join(f"v{k} * pow({s}), 2)" for k, s in enumerate(slopes))
    return (f"SELECT species, '{term}' AS term, ({value}) / sd_{term} AS estimate, sqrt({var}) / sd_{term} AS se "
            f"FROM m WHERE sd_{term} > 0")


_AME = "m AS (SELECT species, " + ", ".join(
    f"avg(mu * {x}) AS m{k}, avg(mu * z_doy * {x}) AS d{k}" for k, x in enumerate(X)) + ", " + ", ".join(
    f"any_value(sd_{t}) AS sd_{t}" for t in TERMS if t != "doy2") + ", " + ", ".join(
    [f"any_value(b{k}) AS b{k}" for k in range(10)] + [f"any_value(v{k}) AS v{k}" for k in range(10)]) + """ FROM fitted GROUP BY species),
    e AS (""" + " UNION ALL ".join(_ame_sql(t) for t in TERMS if t != "doy2") + ")"


@query("avg_marginal_effect", f"""WITH {_AME}
    SELECT species, term, round(estimate, 4) AS estimate, round(estimate - 1.96 * se, 4) AS conf_low,
           round(estimate + 1.96 * se, 4) AS conf_high FROM e""", ("fitted",))
def avg_marginal_effect(t):
    return r(fx.marginal_effects(t.scaled, t.given), 4, "estimate", "conf_low", "conf_high")


def _text(value: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST(round_even({value}, 2) AS DECIMAL(38,2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_EFFECT_TEXT = f"{_text('estimate')} || ' (' || {_text('estimate - 1.96 * se')} || ' to ' || {_text('estimate + 1.96 * se')} || ')'"


@query("effects_table", f"""WITH {_AME},
    k AS (SELECT species, term, {_EFFECT_TEXT} AS txt FROM e WHERE NOT (term = 'tsm' AND species = 'NATION_1')
          UNION ALL SELECT 'All', term, txt FROM (SELECT term, {_EFFECT_TEXT} AS txt FROM e WHERE species = 'NATION_2' AND term IN ('doy', 'pressure')))
    SELECT species, """ + ", ".join(f"max(CASE WHEN term = '{t}' THEN txt END) AS {t}" for t in fx.TABLE_TERMS) + " FROM k GROUP BY species",
       ("fitted",))
def effects_table(t):
    """Printed effects; a missing term is NULL and the pooled row, with two terms, comes last."""
    effects = settle(fx.marginal_effects(t.scaled, t.given), "effects")
    pooled = effects.filter("species = 'NATION_2' and term in ('doy', 'pressure')").withColumn("species", F.lit("All"))
    return fx.effects_table(effects.filter("not (term = 'tsm' and species = 'NATION_1')"), pooled)


@query("pivot_terms", f"""WITH {_AME}
    SELECT species, """ + ", ".join(f"round(max(CASE WHEN term = '{t}' THEN estimate END), 4) AS {t}" for t in fx.TABLE_TERMS) +
       " FROM e GROUP BY species", ("fitted",))
def pivot_terms(t):
    return r(fx.pivot_terms(fx.marginal_effects(t.scaled, t.given), "estimate"), 4, *fx.TABLE_TERMS)


@query("effects_of_fit")
def effects_of_fit(t):
    """Marginal effects of the fitted negative binomial model of every species."""
    return fx.marginal_effects(t.scaled, cm.fit_full(t.stored_frame, ["nbinom"]))


@query("diagnostics_of_fit")
def diagnostics_of_fit(t):
    rows = fx.with_fit(t.scaled, cm.fit_full(t.stored_frame, ["nbinom+zi"]))
    return dg.diagnostics(rows)


@query("dispersion_stat", """
    SELECT species, round(sum(e * e), 4) AS chi2, round(sum(e * e) / (count(*) - 11), 6) AS dispersion FROM fitted GROUP BY species""",
       ("fitted",))
def dispersion_stat(t):
    return r(r(dg.dispersion(_fitted_given(t)), 4, "chi2"), 6, "dispersion")


@query("zero_ratio", """
    SELECT species, count(*) FILTER (birds = 0) AS observed, round(sum(p_zero), 6) AS expected,
           round(count(*) FILTER (birds = 0) / sum(p_zero), 6) AS zero_ratio FROM fitted GROUP BY species""", ("fitted",))
def zero_ratio(t):
    return r(dg.zero_ratio(_fitted_given(t)), 6, "expected", "zero_ratio")


@query("durbin_watson", """WITH
    y AS (SELECT species, year, avg(e) AS e FROM fitted GROUP BY species, year),
    l AS (SELECT *, e - lag(e) OVER (PARTITION BY species ORDER BY year) AS step FROM y)
    SELECT species, round(sum(step * step) / nullif(sum(e * e), 0), 6) AS durbin_watson FROM l GROUP BY species""", ("fitted",))
def durbin_watson(t):
    return r(dg.durbin_watson(_fitted_given(t)), 6, "durbin_watson")


@query("outlier_share", """
    SELECT species, count(*) FILTER (abs(e) > 3) AS outliers, round(avg(CASE WHEN abs(e) > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outlier_share
    FROM fitted GROUP BY species""", ("fitted",))
def outlier_share(t):
    return r(dg.outlier_share(_fitted_given(t)), 6, "outlier_share")


_DAILY = """dl AS (SELECT date, year, observer, ln(1 + sum(birds) / obs_hours) AS y, year - 1998 AS x FROM panel_eff
                   WHERE obs_hours <> 0 AND observer IS NOT NULL GROUP BY date, year, observer, panel_eff.obs_hours)"""


def _daily(t):
    rated = daily_rate(t.panel_eff, ["date", "year", "obs_hours", "observer"])
    return rated.filter("observer is not null").withColumn("group", F.lit("all"))


@query("ols_log_rate", f"""WITH {_DAILY},
    c AS (SELECT observer, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy,
                 sum(x * x) - sum(x) * sum(x) / count(*) AS sxx FROM dl GROUP BY observer),
    b AS (SELECT sum(sxy) / sum(sxx) AS slope FROM c),
    l AS (SELECT observer, my - slope * mx AS level FROM c, b)
    SELECT 'year' AS term, round(slope, 6) AS estimate FROM b
    UNION ALL SELECT 'intercept', round(level, 6) FROM l WHERE observer = 'OB0'
    UNION ALL SELECT 'observer=' || a.observer, round(a.level - z.level, 6) FROM l a, l z
              WHERE z.observer = 'OB0' AND a.observer <> 'OB0'""", ("panel_eff",))
def ols_log_rate(t):
    """log(rate + 1) on year and a category; with one category the slope is the within-category one."""
    fit = linear.log_rate_model(_daily(t), {"observer": None}, 1998)
    return r(fit, 6, "estimate").select("term", "estimate")


@query("ols_two_categories", f"""WITH {_DAILY},
    d AS (SELECT observer, x, y, CASE WHEN dayofweek(date) IN (0, 6) THEN 1.0::DOUBLE ELSE 0 END AS w FROM dl),
    c AS (SELECT *, x - avg(x) OVER o AS a, w - avg(w) OVER o AS b, y - avg(y) OVER o AS r FROM d WINDOW o AS (PARTITION BY observer)),
    s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * r) AS ar, sum(b * r) AS br, sum(r * r) AS rr,
                 count(*) - count(DISTINCT observer) - 2 AS free FROM c),
    e AS (SELECT *, aa * bb - ab * ab AS det, (bb * ar - ab * br) / (aa * bb - ab * ab) AS year, (aa * br - ab * ar) / (aa * bb - ab * ab) AS weekend FROM s),
    v AS (SELECT *, (rr - year * ar - weekend * br) / free AS sigma2 FROM e)
    SELECT 'year' AS term, round(year, 6) AS estimate, round(sqrt(sigma2 * bb / det), 6) AS se FROM v
    UNION ALL SELECT 'weekend=yes', round(weekend, 6), round(sqrt(sigma2 * aa / det), 6) FROM v""", ("panel_eff",))
def ols_two_categories(t):
    """log(rate + 1) on year and two categories; in SQL the larger category is taken out by centring every column on its levels."""
    daily = daily_rate(t.panel_eff, ["date", "year", "obs_hours", "observer"]).filter("observer is not null").withColumns({
        "group": F.lit("all"), "weekend": F.when(F.dayofweek("date").isin(1, 7), "yes").otherwise("no")})
    fit = linear.log_rate_model(daily, {"observer": None, "weekend": None}, 1998)
    return r(fit.filter("term in ('year', 'weekend=yes')"), 6, "estimate", "se").select("term", "estimate", "se")


@query("ols_year_only", f"""WITH {_DAILY}
    SELECT 'year' AS term, round(regr_slope(y, x), 6) AS estimate,
           round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS se FROM dl
    UNION ALL SELECT 'intercept', round(regr_intercept(y, x), 6), round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x))
                     / (count(*) - 2) * (1.0::DOUBLE / count(*) + avg(x) * avg(x) / regr_sxx(y, x))), 6) FROM dl""", ("panel_eff",))
def ols_year_only(t):
    return r(linear.log_rate_model(_daily(t), {}, 1998), 6, "estimate", "se").select("term", "estimate", "se")


@query("log_gamma_check", "SELECT birds, round(lgamma(birds + 0.5), 6) AS lg FROM (SELECT DISTINCT birds FROM frame)", ("frame",))
def log_gamma_check(t):
    return t.frame.select("birds").distinct().select("birds", F.round(log_gamma(F.col("birds") + 0.5), 6).alias("lg"))
