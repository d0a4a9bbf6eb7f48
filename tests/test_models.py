import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tallywing.operators import count_models as cm
from tallywing.operators import diagnostics as dg
from tallywing.operators import effects as fx
from tallywing.operators import linear, scaling, selection, timing
from tallywing.operators.labels import TREND_NAMES
from tallywing.operators.recode import recode

TERMS = ["t1", "t2"]


def simulate(seed, n, theta, extra, beta=(1.0, 0.4, -0.3)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    mu = np.exp(beta[0] + x @ np.array(beta[1:]))
    y = rng.poisson(mu if theta is None else rng.gamma(theta, mu / theta))
    return x, np.where(rng.random(n) < extra, 0, y).astype(float)


def loglik(params, x, y, family):
    """Plain per-row log-likelihood, written from the textbook with math.lgamma."""
    mu = np.exp(np.column_stack([np.ones(len(y)), x]) @ params[:3])
    lg = np.vectorize(math.lgamma)
    if family == "poisson":
        return float(np.sum(y * np.log(mu) - mu - lg(y + 1)))
    th = math.exp(params[3])
    l = lg(y + th) - lg(th) - lg(y + 1) + th * np.log(th / (th + mu)) + y * np.log(mu / (th + mu))
    if family == "nbinom":
        return float(np.sum(l))
    pi = 1 / (1 + math.exp(-params[4]))
    return float(np.sum(np.where(y == 0, np.log(pi + (1 - pi) * np.exp(l)), np.log(1 - pi) + l)))


def brute_maximum(x, y, family, rounds=400):
    """Coordinate search with shrinking steps: slow, and owes nothing to derivatives."""
    size = {"poisson": 3, "nbinom": 4, "nbinom+zi": 5}[family]
    best = np.array([math.log(y.mean()), 0, 0, 0.0, -1.5][:size])
    value, steps = loglik(best, x, y, family), np.full(size, 0.5)
    for _ in range(rounds):
        for j in range(size):
            for sign in (1, -1):
                trial = best.copy()
                trial[j] += sign * steps[j]
                new = loglik(trial, x, y, family)
                if new > value:
                    best, value = trial, new
                    steps[j] *= 1.3
                    break
            else:
                steps[j] *= 0.6
    return best, value


@pytest.fixture(scope="module")
def data():
    return {"p": simulate(1, 300, None, 0.0), "n": simulate(2, 400, 1.3, 0.0), "z": simulate(3, 500, 2.0, 0.3)}


@pytest.fixture(scope="module")
def ready(spark, data):
    rows = [(g, float(v), float(a), float(b)) for g, (x, y) in data.items() for v, (a, b) in zip(y, x)]
    rows += [("none", 0.0, float(i), 0.0) for i in range(5)]
    return cm.prepare(spark.createDataFrame(rows, "group string, y double, x1 double, x2 double"), 2)


@pytest.fixture(scope="module")
def fits(ready):
    families = list(cm.FAMILIES)
    rows = cm.fit_counts(ready, cm.full_models(ready.moments, families, 2), families).collect()
    return {(r["group"], r["family"]): r for r in rows}


@pytest.mark.parametrize("group, family", [("p", "poisson"), ("n", "poisson"), ("n", "nbinom"), ("z", "nbinom"), ("z", "nbinom+zi"), ("n", "nbinom+zi")])
def test_fit_reaches_the_maximum(fits, data, group, family):
    fit, (x, y) = fits[group, family], data[group]
    best, value = brute_maximum(x, y, family)
    assert fit["converged"]
    params = [*fit["beta"], *(v for v in (fit["log_theta"], fit["zeta"]) if v is not None)]
    assert fit["loglik"] == pytest.approx(loglik(np.array(params), x, y, family), abs=1e-6)
    assert fit["loglik"] >= value - 1e-4  # the extra-zero probability is pinned at 3e-7 where there is none
    if family != "nbinom+zi" or group == "z":
        assert fit["beta"] == pytest.approx(list(best[:3]), abs=2e-3)


def test_groups_without_birds_show_that_they_have_no_fit(fits):
    for family in cm.FAMILIES:
        fit = fits["none", family]
        assert not fit["converged"] and fit["beta"] is None and fit["loglik"] is None and fit["n"] == 5


def test_underdispersed_data_pins_theta(fits):
    """No overdispersion: theta runs to its bound and the fit equals the Poisson one."""
    assert fits["p", "nbinom"]["converged"]
    assert fits["p", "nbinom"]["loglik"] == pytest.approx(fits["p", "poisson"]["loglik"], abs=0.5)


def test_standard_errors_match_the_curvature(fits, data):
    fit, (x, y) = fits["n", "poisson"], data["n"]
    design = np.column_stack([np.ones(len(y)), x])
    mu = np.exp(design @ np.array(fit["beta"]))
    want = np.linalg.inv(design.T @ (design * mu[:, None]))
    assert np.allclose(np.array(fit["vcov"]).reshape(3, 3), want, rtol=1e-5)


def test_blocks_do_not_change_the_fit(spark, data, ready):
    """A group split over many tasks in tiny blocks gives the same answer."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        x, y = data["n"]
        rows = [("n", float(v), float(a), float(b)) for v, (a, b) in zip(y, x)]
        many = cm.prepare(spark.createDataFrame(rows, "group string, y double, x1 double, x2 double").repartition(8), 2)
        assert many.blocks.count() > 8 and many.blocks.agg(F.sum("rows")).first()[0] == len(y)
        split = cm.fit_counts(many, cm.full_models(many.moments, ["nbinom"], 2), ["nbinom"]).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = cm.fit_counts(ready, cm.full_models(ready.moments.filter("group = 'n'"), ["nbinom"], 2), ["nbinom"]).first()
    assert split["loglik"] == pytest.approx(whole["loglik"], abs=1e-8)
    assert split["beta"] == pytest.approx(whole["beta"], abs=1e-7)


def test_poisson_agrees_with_spark_ml(spark, data, fits):
    x, y = data["p"]
    df = spark.createDataFrame([(float(v), float(a), float(b)) for v, (a, b) in zip(y, x)], "y double, x1 double, x2 double")
    vector = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df)
    other = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", tol=1e-10, maxIter=50).fit(vector)
    assert fits["p", "poisson"]["beta"] == pytest.approx([other.intercept, *other.coefficients], abs=1e-6)


def test_all_subsets_are_fitted_exactly(spark, data):
    """Every candidate, against one-by-one fits of the same subset."""
    x, y = data["n"]
    frame = spark.createDataFrame([("n", float(v), float(a), float(b)) for v, (a, b) in zip(y, x)], "species string, birds double, t1 double, t2 double")
    ranked = selection.rank_models(selection.scores_of(selection.all_subsets(frame, "nbinom", terms=TERMS))).collect()
    assert len(ranked) == 4 and sum(r["weight"] for r in ranked) == pytest.approx(1.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    for r in ranked:
        keep = [j for j in (0, 1) if (r["mask"] >> j) & 1]
        cut = np.zeros_like(z)
        cut[:, keep] = z[:, keep]
        _, value = brute_maximum(cut, y, "nbinom", rounds=150)
        assert r["loglik"] == pytest.approx(value, abs=1e-3)
        assert r["k"] == len(keep) + 2


def test_model_space_size(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "group string")
    assert selection.model_space(groups).count() == 2 * 384


@pytest.mark.parametrize("k, ll, score", [(9, -3247.43363164783, 6513.17131734971), (10, -3246.9045732218, 6514.18139686661)])
def test_aicc_of_published_rows(one, k, ll, score):
    assert one(selection.aicc(F.lit(ll), F.lit(k), F.lit(602))) == pytest.approx(score, abs=1e-6)


def test_aicc_without_room_is_null(one):
    assert one(selection.aicc(F.lit(-5.0), F.lit(9), F.lit(10))) is None


def test_weights_use_all_models_before_the_cut(spark):
    scores = spark.createDataFrame([("a", i, float(10 + 3 * i)) for i in range(4)], "group string, model_id int, aicc double")
    got = {r["model_id"]: r for r in selection.close_models(selection.rank_models(scores)).collect()}
    raw = [math.exp(-1.5 * i) for i in range(4)]
    assert set(got) == {0, 1} and got[0]["weight"] == pytest.approx(raw[0] / sum(raw))
    assert got[0]["position"] == 1 and got[1]["delta"] == 3.0


def test_marginal_effects_match_a_numeric_slope(spark, data):
    x, y = data["n"]
    rows = [("n", float(v), float(2 * a + 250), float(b)) for v, (a, b) in zip(y, x)]
    frame = spark.createDataFrame(rows, "species string, birds double, doy double, tsm double")
    terms = ["doy", "doy2", "tsm"]
    scaled = scaling.with_terms(frame, terms=terms)
    fit = cm.fit_full(frame, ["nbinom"], terms=terms)
    beta = fit.first()["beta"]
    raw = np.array([[r[2], r[3]] for r in rows])
    mean, sd = raw.mean(axis=0), raw.std(axis=0, ddof=1)

    def expected(shift_doy=0.0, shift_tsm=0.0):
        z1, z2 = (raw[:, 0] + shift_doy - mean[0]) / sd[0], (raw[:, 1] + shift_tsm - mean[1]) / sd[1]
        return np.exp(beta[0] + beta[1] * z1 + beta[2] * z1**2 + beta[3] * z2).mean()

    got = {r["term"]: r for r in fx.marginal_effects(scaled, fit, terms).collect()}
    h = 1e-4
    assert got["doy"]["estimate"] == pytest.approx((expected(h) - expected(-h)) / (2 * h), rel=1e-5)
    assert got["tsm"]["estimate"] == pytest.approx((expected(0, h) - expected(0, -h)) / (2 * h), rel=1e-5)
    assert got["doy"]["conf_low"] < got["doy"]["estimate"] < got["doy"]["conf_high"]


def test_diagnostics_of_a_good_fit(spark, data):
    x, y = data["n"]
    frame = spark.createDataFrame([("n", 2000 + i % 6, float(v), float(a), float(b)) for i, (v, (a, b)) in enumerate(zip(y, x))],
                                  "species string, year int, birds double, t1 double, t2 double")
    fit = cm.fit_full(frame, ["nbinom"], terms=TERMS)
    rows = fx.with_fit(scaling.with_terms(frame, terms=TERMS), fit, TERMS)
    got = dg.diagnostics(rows).first()
    assert 0.7 < got["dispersion"] < 1.3 and 0.7 < got["zero_ratio"] < 1.3
    assert 0 < got["durbin_watson"] < 4.1 and got["outlier_share"] < 0.05
    single = [dg.dispersion(rows), dg.zero_ratio(rows), dg.durbin_watson(rows), dg.outlier_share(rows)]
    for part, name in zip(single, ("dispersion", "zero_ratio", "durbin_watson", "outlier_share")):
        assert got[name] == pytest.approx(part.first()[name])
    assert dg.log_likelihood(rows).first()["loglik"] == pytest.approx(fit.first()["loglik"], abs=1e-6)


def test_flat_term_is_harmless(spark):
    rows = [("a", float(i % 4), 5.0, float(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "species string, birds double, t1 double, t2 double")
    fit = cm.fit_full(frame, ["poisson"], terms=TERMS).first()
    assert fit["converged"] and fit["beta"][1] == pytest.approx(0.0, abs=1e-9)


def test_ols_leaves_out_what_depends_on_earlier_terms(spark):
    """A copy, a sum and a constant have no estimate; the others are those without them, in groups of many parts and of few rows."""
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 500)) + 2000.0
    y = 3 + 0.5 * a - 2 * b + rng.normal(size=500)
    rows = [("g", *map(float, r)) for r in zip(a, a, b, a + b, np.ones(500), y)] + [("few", 1.0, 1.0, 2.0, 3.0, 1.0, 5.0), ("few", 2.0, 2.0, 7.0, 9.0, 1.0, 6.0)]
    df = spark.createDataFrame(rows, "group string, a double, copy double, b double, total double, one double, y double").repartition(9)
    got = {(r["group"], r["term"]): r for r in linear.ols(df, "y", ["a", "copy", "b", "total", "one"]).collect()}
    x = np.column_stack([np.ones(500), a - a.mean(), b - b.mean()])
    beta, rest, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(rest[0] / 497 * np.diag(np.linalg.inv(x.T @ x)))
    for j, term in ((1, "a"), (2, "b")):
        assert got["g", term]["estimate"] == pytest.approx(beta[j], rel=1e-6) and got["g", term]["se"] == pytest.approx(se[j], rel=1e-6)
    for term in ("copy", "total", "one"):
        assert got["g", term]["estimate"] is None and got["g", term]["se"] is None
    assert got["few", "a"]["estimate"] == pytest.approx(1.0) and got["few", "b"]["estimate"] is None and got["few", "a"]["se"] is None


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ np.array([2.0, -1.0]) + rng.normal(size=60) * 0.3
    df = spark.createDataFrame([("g", float(v), float(a), float(b)) for v, (a, b) in zip(y, x)], "group string, y double, a double, b double")
    got = {r["term"]: r for r in linear.ols(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(60), x])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 57)
    assert [got[t]["estimate"] for t in ("intercept", "a", "b")] == pytest.approx(list(beta))
    assert [got[t]["se"] for t in ("intercept", "a", "b")] == pytest.approx(list(se))


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(7)
    rows = [(s, y, float(270 + i * 5 + slope * (y - 2020) + rng.normal())) for i, (s, slope) in enumerate([("a", 1.5), ("b", -0.5), ("c", 0.0)]) for y in range(2016, 2025)]
    return spark.createDataFrame(rows + [("a", 2025, None)], "species string, year int, mean_doy double")


def test_timing_trends(days):
    import pandas as pd

    pdf = days.toPandas().dropna()
    trends = timing.species_trends(days)
    got = {r["species"]: r["slope"] for r in trends.collect()}
    for s, g in pdf.groupby("species"):
        assert got[s] == pytest.approx(np.polyfit(g["year"] - 2020, g["mean_doy"], 1)[0])
    pooled = timing.pooled_trend(trends).first()
    dummies = pd.get_dummies(pdf["species"]).to_numpy(float)
    design = np.column_stack([pdf["year"] - 2020, dummies])
    beta, rss, *_ = np.linalg.lstsq(design, pdf["mean_doy"], rcond=None)
    # maximum likelihood with random levels on a balanced panel: rows less one a species (see test_lossless for the dense likelihood)
    assert pooled["slope"] == pytest.approx(beta[0]) and pooled["df"] == 27 - 3
    assert pooled["se"] == pytest.approx(np.sqrt(rss[0] / 24 * np.linalg.inv(design.T @ design)[0, 0]))


def test_slope_tests_use_the_pooled_variance(days):
    trends = timing.species_trends(days)
    rows = timing.slope_tests(trends).collect()
    sigma2 = sum(r["rss"] for r in trends.collect()) / 27
    for r in rows:
        assert r["df"] == 27 - 7 and r["se"] == pytest.approx(math.sqrt(sigma2 / 60))
        assert r["t_ratio"] == pytest.approx(r["year_trend"] / r["se"]) and r["uci"] - r["lci"] == pytest.approx(3.92 * r["se"])


def test_shift_is_slope_times_span(days):
    trends = timing.species_trends(days)
    slope = {r["species"]: r["slope"] for r in trends.collect()}
    for r in timing.shift(timing.predict_species(days, trends), "species").collect():
        assert r["shift"] == pytest.approx(8 * slope[r["species"]])


def test_season_without_birds_has_no_mean_day(spark):
    frame = spark.createDataFrame([("a", 2020, 250, 0.0), ("a", 2021, 240, 1.0), ("a", 2021, 260, 3.0)], "species string, year int, doy int, birds double")
    got = {r["year"]: r["mean_doy"] for r in timing.weighted_mean_day(frame).collect()}
    assert got == {2020: None, 2021: 255.0}


def test_trend_names(one):
    assert one(recode(F.lit("GRCO"), list(TREND_NAMES.items()))) == "Phalacrocorax carbo"
