"""Migration timing: weighted days, trends, tests, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.operators import timing as tm
from tallywing.plans.catalog import query
from tallywing.session import settle

_DAYS = """days_by AS (SELECT species, year, sum(doy * birds) / nullif(sum(birds), 0) AS mean_doy FROM frame GROUP BY species, year)"""
_TRENDS = f"""{_DAYS},
    tr AS (SELECT species, count(*) AS n, regr_slope(mean_doy, year) AS slope, regr_intercept(mean_doy, year) AS intercept,
                  regr_sxx(mean_doy, year) AS sxx, regr_sxy(mean_doy, year) AS sxy, regr_syy(mean_doy, year) AS syy,
                  avg(year) AS mean_x, avg(mean_doy) AS mean_y,
                  regr_syy(mean_doy, year) - coalesce(regr_slope(mean_doy, year), 0) * regr_sxy(mean_doy, year) AS rss
           FROM days_by WHERE mean_doy IS NOT NULL GROUP BY species)"""
#: The pooled line by maximum likelihood, from ``m``, a row a species: its years, means and sums within. At a variance ratio ``l`` a
#: species' mean weighs n / (1 + n l); the search halves its way to the ratio where the likelihood's slope is 0.
_AT = """SELECT {keep}, sum(n / (1 + n * l)) AS w, sum(n / (1 + n * l) * mx) / sum(n / (1 + n * l)) AS ax, sum(n / (1 + n * l) * my) / sum(n / (1 + n * l)) AS ay
         FROM {rows}, m GROUP BY {keep}"""
_AT2 = """SELECT b.*, (sum(sxy) + sum(n / (1 + n * l) * (mx - ax) * (my - ay))) / (sum(sxx) + sum(n / (1 + n * l) * (mx - ax) * (mx - ax))) AS slope,
                 sum(sxx) + sum(n / (1 + n * l) * (mx - ax) * (mx - ax)) AS xx,
                 sum(syy) + sum(n / (1 + n * l) * (my - ay) * (my - ay)) AS yy, sum(n) AS rows, count(*) AS g FROM ({at}) b, m GROUP BY ALL"""
_AT3 = """SELECT c.*, yy - slope * slope * xx AS rss, sum(pow(n / (1 + n * l) * (my - ay - slope * (mx - ax)), 2)) AS squares FROM ({at2}) c, m GROUP BY ALL"""


def _at(rows: str, keep: str) -> str:
    return _AT3.format(at2=_AT2.format(at=_AT.format(rows=rows, keep=keep)))


_SEARCHED = f"""search(step, low, high) AS (
        SELECT 0, -30.0::DOUBLE, 30.0::DOUBLE
        UNION ALL
        SELECT step + 1, CASE WHEN rows * squares / rss > w THEN mid ELSE low END, CASE WHEN rows * squares / rss > w THEN high ELSE mid END
        FROM ({_at("(SELECT step, low, high, (low + high) / 2 AS mid, exp((low + high) / 2) AS l FROM search WHERE step < 60)", "step, low, high, mid, l")})),
    p1 AS (SELECT rows AS n, g, slope, xx AS sxx, ax + 1990 AS mean_x, ay AS mean_y, rss / rows AS sigma2, l * rss / rows AS levels, w
           FROM ({_at("(SELECT exp((low + high) / 2) AS l FROM search WHERE step = 60)", "l")}))"""
_POOLED = f"""{_TRENDS},
    m AS (SELECT n, mean_x - 1990 AS mx, mean_y AS my, sxx, sxy, syy FROM tr),
    {_SEARCHED}"""
_TESTED = f"""{_TRENDS},
    u AS (SELECT * FROM tr WHERE sxx > 0),
    v AS (SELECT *, sum(rss) OVER () / sum(n) OVER () AS sigma2, CAST(sum(n) OVER () - 2 * count(*) OVER () - 1 AS BIGINT) AS df FROM u),
    s AS (SELECT *, sqrt(sigma2 / sxx) AS se, slope / sqrt(sigma2 / sxx) AS t_ratio FROM v)"""


def _days(t):
    return tm.weighted_mean_day(t.frame)


def _settled(t):
    """The species-year table is read by several aggregates; it is small, so it is written once."""
    days = settle(_days(t), "days")
    return days, tm.species_trends(days)


def _r(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("weighted_mean_doy", f"WITH {_DAYS} SELECT species, year, round(mean_doy, 6) AS mean_doy FROM days_by", ("frame",))
def weighted_mean_doy(t):
    return _r(_days(t), 6, "mean_doy")


@query("join_names", f"""WITH {_DAYS}
    SELECT sci_name, species AS code, year, round(mean_doy, 6) AS mean_doy FROM days_by LEFT JOIN species_meta USING (species)""",
       ("frame", "species_meta"))
def join_names(t):
    return _r(tm.with_names(_days(t), t.species_meta), 6, "mean_doy")


@query("timing_trend_species", f"""WITH {_TRENDS}
    SELECT species, n, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(sxx, 6) AS sxx FROM tr""", ("frame",))
def timing_trend_species(t):
    rows = tm.species_trends(_days(t)).select("species", "n", "slope", "intercept", "sxx")
    return _r(_r(rows, 6, "slope", "sxx"), 3, "intercept")


@query("timing_trend_all", f"""WITH RECURSIVE {_POOLED}
    SELECT CAST(n AS BIGINT) AS n, CAST(n - g AS BIGINT) AS df, round(slope, 6) AS slope, round(mean_y - slope * mean_x, 3) AS intercept,
           round(sqrt(sigma2 / sxx), 6) AS se, round(slope - 1.96 * sqrt(sigma2 / sxx), 6) AS lci,
           round(slope + 1.96 * sqrt(sigma2 / sxx), 6) AS uci
    FROM p1""", ("frame",))
def timing_trend_all(t):
    rows = tm.pooled_trend(_settled(t)[1]).select("n", "df", "slope", "intercept", "se", "lci", "uci")
    return _r(_r(rows, 6, "slope", "se", "lci", "uci"), 3, "intercept")


@query("timing_slope_test", f"""WITH {_TESTED},
    q AS (SELECT *, atan(abs(t_ratio) / sqrt(df)) AS theta FROM s),
    sums AS (SELECT q.species, sum(CASE WHEN df % 2 = 1 THEN exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(theta), 2 * k + 1)
                                        ELSE exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(theta), 2 * k) END) AS total
             FROM q, (SELECT unnest(range(0, (SELECT max(df) FROM q) // 2 + 1)) AS k)
             WHERE k <= CASE WHEN df % 2 = 1 THEN (df - 3) / 2 ELSE (df - 2) / 2 END GROUP BY q.species)
    SELECT species, round(slope, 6) AS year_trend, round(slope - 1.96 * se, 6) AS lci, round(slope + 1.96 * se, 6) AS uci,
           round(se, 6) AS se, df, round(t_ratio, 6) AS t_ratio,
           round(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (theta + CASE WHEN df = 1 THEN 0 ELSE sin(theta) * total END)
                          ELSE sin(theta) * total END, 6) AS p_value
    FROM q LEFT JOIN sums USING (species)""", ("frame",))
def timing_slope_test(t):
    rows = tm.slope_tests(_settled(t)[1]).orderBy("p_value", "species")
    return _r(rows, 6, "year_trend", "lci", "uci", "se", "t_ratio", "p_value")


_PREDICT_ALL = f"""{_POOLED},
    pr AS (SELECT year, mean_y + slope * (year - mean_x) AS predicted, sqrt(sigma2 * (1 / w + (year - mean_x) * (year - mean_x) / sxx)) AS se
           FROM (SELECT DISTINCT year FROM days_by WHERE mean_doy IS NOT NULL), p1)"""
_PREDICT_SPECIES = f"""{_TESTED},
    ps AS (SELECT s.species, d.year, mean_y + slope * (d.year - mean_x) AS predicted,
                  sqrt(sigma2 * (1.0::DOUBLE / n + (d.year - mean_x) * (d.year - mean_x) / sxx)) AS se
           FROM (SELECT DISTINCT species, year FROM days_by WHERE mean_doy IS NOT NULL) d JOIN s USING (species))"""
_BANDS = "round(predicted, 4) AS predicted, round(predicted - 1.96 * se, 4) AS conf_low, round(predicted + 1.96 * se, 4) AS conf_high"


@query("timing_predict_all", f"WITH RECURSIVE {_PREDICT_ALL} SELECT year, {_BANDS} FROM pr", ("frame",))
def timing_predict_all(t):
    return _r(tm.predict_all(*_settled(t)), 4, "predicted", "conf_low", "conf_high")


@query("timing_predict", f"WITH {_PREDICT_SPECIES} SELECT species, year, {_BANDS} FROM ps", ("frame",))
def timing_predict(t):
    return _r(tm.predict_species(*_settled(t)), 4, "predicted", "conf_low", "conf_high")


@query("timing_shift", f"""WITH {_PREDICT_SPECIES}
    SELECT species, round(max_by(predicted, year) - min_by(predicted, year), 6) AS shift FROM ps GROUP BY species""", ("frame",))
def timing_shift(t):
    return _r(tm.shift(tm.predict_species(*_settled(t)), "species"), 6, "shift")


@query("timing_shift_all", f"WITH RECURSIVE {_PREDICT_ALL} SELECT round(max_by(predicted, year) - min_by(predicted, year), 6) AS shift FROM pr",
       ("frame",))
def timing_shift_all(t):
    return _r(tm.shift(tm.predict_all(*_settled(t))), 6, "shift")


@query("levene_f", f"""WITH {_TESTED},
    r AS (SELECT d.species, mean_doy - intercept - slope * year AS r FROM days_by d JOIN u USING (species) WHERE mean_doy IS NOT NULL),
    z AS (SELECT species, abs(r - median(r) OVER (PARTITION BY species)) AS z FROM r),
    g AS (SELECT species, count(*) AS n, avg(z) AS zbar, var_pop(z) AS within FROM z GROUP BY species),
    f AS (SELECT count(*) AS k, sum(n) AS n, sum(n * within) AS w, sum(n * zbar * zbar) - sum(n * zbar) * sum(n * zbar) / sum(n) AS b FROM g),
    vv AS (SELECT CAST(k - 1 AS BIGINT) AS df1, CAST(n - k AS BIGINT) AS df2, (b / (k - 1)) / (w / (n - k)) AS f FROM f),
    qq AS (SELECT *, ln(df2 / (df1 * f)) AS y, df2 / 2.0::DOUBLE AS a, df1 / 2.0::DOUBLE AS c FROM vv),
    ss AS (SELECT df1, df2, f, sum((CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(
                     lgamma(a + c) - lgamma(a) - lgamma(c) - a * ln(1 + exp(i * 0.002::DOUBLE - y)) - c * ln(1 + exp(y - i * 0.002::DOUBLE)))) * 0.002::DOUBLE / 3 AS p
          FROM qq, (SELECT unnest(range(0, 20001)) AS i) GROUP BY df1, df2, f)
    SELECT df1, df2, round(f, 6) AS f, round(p, 9) AS p_value FROM ss""", ("frame",))
def levene_f(t):
    """The p-value in SQL is the beta integral in log odds by Simpson's rule, 40 units down from the statistic."""
    return _r(_r(tm.equal_variance(*_settled(t)), 6, "f"), 9, "p_value")


_GAPS = "CAST(right(species, 1) AS INTEGER) % 4 <> year % 4 AND (species <> 'NATION_3' OR year % 3 = 0)"
_SOME = f"""{_DAYS},
    m AS (SELECT count(*) AS n, avg(year) - 1990 AS mx, avg(mean_doy) AS my, regr_sxx(mean_doy, year) AS sxx, regr_sxy(mean_doy, year) AS sxy, regr_syy(mean_doy, year) AS syy
          FROM days_by WHERE mean_doy IS NOT NULL AND {_GAPS} GROUP BY species)"""
@query("timing_trend_unbalanced", f"""WITH RECURSIVE {_SOME},
    {_SEARCHED}
    SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(sqrt(sigma2 / sxx), 6) AS se, round(sigma2, 4) AS sigma2,
           round(levels, 4) AS levels, round(mean_y - slope * mean_x, 3) AS intercept FROM p1""", ("frame",))
def timing_trend_unbalanced(t):
    """The pooled line where species miss years, one of them nearly all: SQL halves its way to the same variance ratio over all species."""
    some = _settled(t)[0].filter(_GAPS.replace("CAST(right(species, 1) AS INTEGER)", "cast(right(species, 1) as int)"))
    rows = tm.pooled_trend(tm.species_trends(some)).select("n", "slope", "se", "sigma2", "levels", "intercept")
    return _r(_r(_r(rows, 6, "slope", "se"), 4, "sigma2", "levels"), 3, "intercept")
