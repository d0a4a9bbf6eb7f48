"""Summary, composition, quality and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.operators import composition as comp
from tallywing.operators import quality
from tallywing.operators import summary as s
from tallywing.operators.panel import collapse_duplicates, detections, drop_no_effort, frequent_only
from tallywing.operators.recode import lookup
from tallywing.plans.catalog import query

_KEPT = "NOT (birds = 0 AND obs_hours = 0)"
_EFFORT = "eff AS (SELECT DISTINCT year, date, obs_hours FROM panel_eff)"


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("total_count", "SELECT sum(birds) AS birds FROM panel", ("panel",))
def total_count(t):
    return s.total_birds(t.panel)


@query("totals_by_species", "SELECT species, sum(birds) AS total_birds FROM panel GROUP BY species", ("panel",))
def totals_by_species(t):
    return s.totals(t.panel, "species")


@query("totals_by_species_year", "SELECT species, year, sum(birds) AS total_birds FROM panel GROUP BY ALL", ("panel",))
def totals_by_species_year(t):
    return s.totals(t.panel, "species", "year")


@query("survey_days", f"SELECT count(DISTINCT date) AS survey_days FROM panel_eff WHERE {_KEPT}", ("panel_eff",))
def survey_days(t):
    return s.survey_days(drop_no_effort(t.panel_eff))


@query("days_per_year", f"SELECT year, count(DISTINCT date) AS days FROM panel_eff WHERE {_KEPT} GROUP BY year", ("panel_eff",))
def days_per_year(t):
    return s.days_per_year(drop_no_effort(t.panel_eff))


@query("days_per_year_stats", f"""
    SELECT round(avg(days), 6) AS mean_days, round(stddev_samp(days), 6) AS sd_days
    FROM (SELECT year, count(DISTINCT date) AS days FROM panel_eff WHERE {_KEPT} GROUP BY year)""", ("panel_eff",))
def days_per_year_stats(t):
    return r6(s.days_per_year_stats(drop_no_effort(t.panel_eff)), "mean_days", "sd_days")


@query("total_effort", "SELECT round(sum(obs_hours), 6) AS total_hours FROM (SELECT DISTINCT date, obs_hours FROM panel_eff)",
       ("panel_eff",))
def total_effort(t):
    return r6(s.total_effort(t.panel_eff), "total_hours")


@query("repeated_effort", "SELECT round(sum(obs_hours), 4) AS row_hours FROM panel_eff", ("panel_eff",))
def repeated_effort(t):
    return s.repeated_effort(t.panel_eff).select(F.round("row_hours", 4).alias("row_hours"))


@query("effort_by_year", f"""WITH {_EFFORT}
    SELECT year, round(sum(obs_hours), 6) AS total_effort FROM eff GROUP BY year""", ("panel_eff",))
def effort_by_year(t):
    return r6(s.effort_by_year(t.panel_eff), "total_effort")


@query("mean_effort_per_year", f"""WITH {_EFFORT}
    SELECT round(avg(h), 6) AS mean_effort FROM (SELECT year, sum(obs_hours) AS h FROM eff GROUP BY year)""", ("panel_eff",))
def mean_effort_per_year(t):
    return r6(s.mean_effort_per_year(t.panel_eff), "mean_effort")


@query("mean_daily_effort", f"""WITH {_EFFORT}
    SELECT year, round(avg(obs_hours), 6) AS mean_daily_effort FROM eff GROUP BY year""", ("panel_eff",))
def mean_daily_effort(t):
    return r6(s.mean_daily_effort(t.panel_eff), "mean_daily_effort")


@query("mean_of_yearly_means", f"""WITH {_EFFORT}
    SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT year, avg(obs_hours) AS m FROM eff GROUP BY year)""", ("panel_eff",))
def mean_of_yearly_means(t):
    return r6(s.mean_of_yearly_means(t.panel_eff), "mean_of_means")


@query("bph_by_year", f"""WITH {_EFFORT},
    h AS (SELECT year, sum(obs_hours) AS total_effort FROM eff GROUP BY year),
    b AS (SELECT year, sum(birds) AS total_birds FROM panel_eff GROUP BY year)
    SELECT year, total_birds, round(total_effort, 6) AS total_effort,
           round(total_birds / nullif(total_effort, 0), 6) AS birds_per_hour
    FROM b LEFT JOIN h USING (year)""", ("panel_eff",))
def bph_by_year(t):
    return r6(s.rate_by_year(t.panel_eff), "total_effort", "birds_per_hour")


@query("bph_by_observer", """
    SELECT observer, round(sum(obs_hours), 4) AS total_effort, sum(birds) AS total_birds,
           round(sum(birds) / nullif(sum(obs_hours), 0), 6) AS birds_per_hour
    FROM panel_eff GROUP BY observer""", ("panel_eff",))
def bph_by_observer(t):
    rated = s.rate_by(t.panel_eff, "observer")
    return rated.withColumns({"total_effort": F.round("total_effort", 4), "birds_per_hour": F.round("birds_per_hour", 6)})


@query("bph_by_year_repeated", """
    SELECT year, round(sum(obs_hours), 4) AS total_effort, sum(birds) AS total_birds,
           round(sum(birds) / nullif(sum(obs_hours), 0), 6) AS birds_per_hour
    FROM panel_eff GROUP BY year""", ("panel_eff",))
def bph_by_year_repeated(t):
    rated = s.rate_by(t.panel_eff, "year")
    return rated.withColumns({"total_effort": F.round("total_effort", 4), "birds_per_hour": F.round("birds_per_hour", 6)})


@query("bph_by_species", """
    SELECT species, sum(birds) AS total_birds, 1879.15::DOUBLE AS total_effort,
           round(sum(birds) / 1879.15::DOUBLE, 6) AS birds_per_hour
    FROM panel GROUP BY species""", ("panel",))
def bph_by_species(t):
    return r6(s.rate_at_effort(t.panel, 1879.15, "species"), "birds_per_hour")


@query("daily_bph", """
    SELECT date, year, observer, round(obs_hours, 6) AS obs_hours, sum(birds) AS total_birds,
           round(sum(birds) / obs_hours, 6) AS birds_per_hour
    FROM panel_eff WHERE obs_hours <> 0 GROUP BY date, year, observer, panel_eff.obs_hours""", ("panel_eff",), dates=("date",))
def daily_bph(t):
    return r6(s.daily_rate(t.panel_eff, ["date", "year", "obs_hours", "observer"]), "obs_hours", "birds_per_hour")


@query("detections_by_species", "SELECT species, count(*) AS n FROM panel WHERE birds > 0 GROUP BY species", ("panel",))
def detections_by_species(t):
    return detections(t.panel)


@query("days_by_category", """
    SELECT observer, count(*) AS n FROM (SELECT DISTINCT date, observer FROM panel_eff WHERE observer IS NOT NULL)
    GROUP BY observer""", ("panel_eff",))
def days_by_category(t):
    return s.days_by_category(t.panel_eff, "observer")


@query("observer_codes", "SELECT DISTINCT observer FROM panel_eff WHERE observer IS NOT NULL ORDER BY observer", ("panel_eff",))
def observer_codes(t):
    return quality.distinct_values(t.panel_eff.filter("observer is not null"), "observer")


@query("collapse_dupes", "SELECT species, date, sum(birds) AS birds FROM panel GROUP BY species, date", ("panel",), dates=("date",))
def collapse_dupes(t):
    return collapse_duplicates(t.panel)


@query("detection_days", """
    SELECT species, count(*) AS detection_days
    FROM (SELECT species, date FROM panel GROUP BY species, date HAVING sum(birds) > 0) GROUP BY species""", ("panel",))
def detection_days(t):
    return s.detection_days(t.panel)


_SEEN = "seen AS (SELECT species, period FROM detect GROUP BY species, period HAVING sum(birds) > 0)"


@query("years_detected", f"WITH {_SEEN} SELECT species, count(*) AS years_detected FROM seen GROUP BY species", ("detect",))
def years_detected(t):
    return s.years_detected(t.detect, "period")


@query("species_all_years", f"""WITH {_SEEN}
    SELECT species, count(*) AS years_detected FROM seen GROUP BY species
    HAVING count(*) = (SELECT count(DISTINCT period) FROM detect)""", ("detect",))
def species_all_years(t):
    return s.seen_every_period(t.detect, "period")


_GROUP_CASE = ("CASE grouping WHEN 'AFRICA' THEN 'Cormorants' WHEN 'AMERICA' THEN 'Alcids' WHEN 'ASIA' THEN 'Larids' "
               "WHEN 'EUROPE' THEN 'Grebes' ELSE 'Loons' END")
_GROUPS = {"AFRICA": "Cormorants", "AMERICA": "Alcids", "ASIA": "Larids", "EUROPE": "Grebes"}


@query("flight_composition", f"""WITH
    g AS (SELECT p.birds, {_GROUP_CASE} AS grouping FROM panel p LEFT JOIN species_groups USING (species)),
    f AS (SELECT birds, CASE WHEN grouping IN ('Alcids', 'Grebes') THEN 'Other waterbirds'
                             WHEN grouping = 'Larids' THEN 'Gulls' ELSE grouping END AS grouping FROM g),
    k AS (SELECT grouping, sum(birds) AS total FROM f GROUP BY grouping ORDER BY total DESC, grouping LIMIT 8)
    SELECT grouping, total, round(100 * total / sum(total) OVER (), 6) AS percent,
           CAST(list_position(['Cormorants', 'Scoters', 'Common Eider', 'Northern Gannet', 'Other ducks/geese', 'Loons',
                               'Gulls', 'Other waterbirds'], grouping) AS INTEGER) AS plot_order
    FROM k""", ("panel", "species_groups"))
def flight_composition(t):
    groups = t.species_groups.withColumn("grouping", F.coalesce(lookup(F.col("grouping"), _GROUPS), F.lit("Loons")))
    return r6(comp.flight_composition(s.totals(t.panel, "species"), groups), "percent")


@query("composition_by_species", """WITH
    k AS (SELECT species, sum(birds) AS total FROM panel GROUP BY species ORDER BY total DESC, species LIMIT 8)
    SELECT species, total, round(100 * total / sum(total) OVER (), 6) AS percent FROM k""", ("panel",))
def composition_by_species(t):
    return r6(comp.composition(t.panel, "species", "birds"), "percent")


@query("qc_rows_per_date", "SELECT date, count(*) AS n FROM panel GROUP BY date", ("panel",), dates=("date",))
def qc_rows_per_date(t):
    return quality.rows_per(t.panel, "date")


@query("qc_rows_per_species", "SELECT species, count(*) AS n FROM panel GROUP BY species", ("panel",))
def qc_rows_per_species(t):
    return quality.rows_per(t.panel, "species")


@query("qc_distinct_values", "SELECT DISTINCT birds FROM panel ORDER BY birds", ("panel",))
def qc_distinct_values(t):
    return quality.distinct_values(t.panel, "birds")


@query("bph_histogram", """
    SELECT CAST(floor(bph / 5.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n
    FROM (SELECT round(sum(birds) / obs_hours, 6) AS bph FROM panel_eff
          WHERE obs_hours <> 0 GROUP BY date, observer, panel_eff.obs_hours)
    GROUP BY bin""", ("panel_eff",))
def bph_histogram(t):
    rated = s.daily_rate(t.panel_eff, ["date", "observer", "obs_hours"])
    return s.rate_histogram(rated, F.round("birds_per_hour", 6), 5.0)


@query("topk_groups", """
    SELECT species, total_birds, CAST(row_number() OVER (ORDER BY total_birds DESC, species) AS INTEGER) AS position
    FROM (SELECT species, sum(birds) AS total_birds FROM panel GROUP BY species)
    QUALIFY position < 9""", ("panel",))
def topk_groups(t):
    return s.positions(s.totals(t.panel, "species"), "total_birds", "species").filter("position < 9")


@query("species_ranked", "SELECT species, sum(birds) AS total_birds FROM panel GROUP BY species ORDER BY total_birds DESC, species",
       ("panel",))
def species_ranked(t):
    return s.ranked(s.totals(t.panel, "species"), "total_birds", "species")


@query("top20_species", """
    SELECT species, sum(birds) AS total_birds FROM panel GROUP BY species ORDER BY total_birds DESC, species LIMIT 20""", ("panel",))
def top20_species(t):
    return s.top(s.totals(t.panel, "species"), 20, "total_birds", "species")


@query("sorted_panel", "SELECT date, species, sum(birds) AS birds FROM panel GROUP BY date, species ORDER BY date, species", ("panel",), dates=("date",))
def sorted_panel(t):
    return collapse_duplicates(t.panel, ["date", "species"]).orderBy("date", "species")


@query("filter_by_frequency", """
    SELECT p.species, p.date, p.birds, n FROM panel p
    JOIN (SELECT species, count(*) AS n FROM panel WHERE birds > 0 GROUP BY species) USING (species)
    WHERE n > 30 AND NOT regexp_matches(p.species, '(?i)n_1')""", ("panel",), dates=("date",))
def filter_by_frequency(t):
    from tallywing.operators.panel import without_unidentified

    return without_unidentified(frequent_only(t.panel, 30), "(?i)n_1").select("species", "date", "birds", "n")
