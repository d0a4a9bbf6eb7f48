"""Projections, filters, recodes, casts, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.functions import dates as d
from tallywing.functions import numbers as n
from tallywing.functions import text as x
from tallywing.operators import panel as p
from tallywing.operators.recode import factor_code, recode, recode_from_table
from tallywing.operators.summary import seen_every_period, top, totals
from tallywing.plans.catalog import query
from tallywing.session import settle
from tallywing.sources import tables


@query("proj_select", "SELECT species, date, birds AS n, observer AS obs FROM panel_eff", ("panel_eff",), dates=("date",))
def proj_select(t):
    return t.panel_eff.drop("year", "obs_hours", "birds_per_hour", "total_obs_mins").select(
        "species", "date", F.col("birds").alias("n"), F.col("observer").alias("obs")
    )


@query("proj_range", "SELECT species, date, year, birds FROM panel_eff", ("panel_eff",), dates=("date",))
def proj_range(t):
    columns = t.panel_eff.columns
    return t.panel_eff.select("species", *columns[columns.index("date"):columns.index("birds") + 1])


@query("derive_bph", """
    SELECT species, date, CAST(year(date) AS INTEGER) AS year, birds, round(total_obs_mins / 60.0::DOUBLE, 6) AS obs_hours,
           round(birds / nullif(total_obs_mins / 60.0::DOUBLE, 0), 6) AS birds_per_hour
    FROM panel_eff""", ("panel_eff",), dates=("date",))
def derive_bph(t):
    derived = p.derive_rates(t.panel_eff.select("species", "date", "birds", "total_obs_mins"))
    return derived.select(
        "species", "date", "year", "birds", F.round("obs_hours", 6).alias("obs_hours"),
        F.round("birds_per_hour", 6).alias("birds_per_hour"),
    )


_SPECIES_RULES = [("NATION_1", "NATION_2"), ("NATION_2", "NATION_3"), ("NATION_9", "NATION_8"), ("NATION_8", "NATION_9"),
                  ("NATION_4", None)]


@query("recode_chain", """
    SELECT CASE species WHEN 'NATION_1' THEN 'NATION_3' WHEN 'NATION_2' THEN 'NATION_3' WHEN 'NATION_8' THEN 'NATION_9'
           WHEN 'NATION_4' THEN NULL ELSE species END AS species, sum(birds) AS birds
    FROM panel GROUP BY 1""", ("panel",))
def recode_chain(t):
    """Ordered rules: 1 becomes 2 and then 3; 9 becomes 8 and then 9 again; 4 becomes unknown."""
    return p.collapse_duplicates(t.panel.withColumn("species", recode(F.col("species"), _SPECIES_RULES)), ["species"])


@query("recode_table", """
    SELECT coalesce(grouping, species) AS species, sum(birds) AS birds
    FROM panel LEFT JOIN (SELECT * FROM species_groups WHERE grouping <> 'ASIA') USING (species) GROUP BY 1""",
       ("panel", "species_groups"))
def recode_table(t):
    """The same with a mapping table instead of fixed rules."""
    kept = t.species_groups.filter("grouping <> 'ASIA'")
    return p.collapse_duplicates(recode_from_table(t.panel, "species", kept, "species", "grouping"), ["species"])


_OBSERVER_RULES = [("OB0", "A"), ("OB1", "A/B"), ("A/B", "B/A"), ("OB4", None), ("OB2", "A")]


@query("recode_observer", """
    SELECT CASE observer WHEN 'OB0' THEN 'A' WHEN 'OB1' THEN 'B/A' WHEN 'OB4' THEN NULL WHEN 'OB2' THEN 'A'
           ELSE observer END AS observer, count(*) AS n
    FROM panel_eff GROUP BY 1""", ("panel_eff",))
def recode_observer(t):
    named = t.panel_eff.withColumn("observer", recode(F.col("observer"), _OBSERVER_RULES))
    return named.groupBy("observer").agg(F.count("*").alias("n"))


@query("case_default", """
    SELECT species, CASE species WHEN 'NATION_1' THEN 'Gavia' WHEN 'NATION_2' THEN 'Cepphus' ELSE 'error' END AS sci_name,
           sum(birds) AS birds FROM panel GROUP BY species""", ("panel",))
def case_default(t):
    name = F.when(F.col("species") == "NATION_1", "Gavia").when(F.col("species") == "NATION_2", "Cepphus").otherwise("error")
    return totals(t.panel, "species", name="birds").withColumn("sci_name", name)


@query("group_override", """
    SELECT species, grouping, CASE species WHEN 'NATION_3' THEN 'Eider' WHEN 'NATION_5' THEN 'Loon' ELSE grouping END AS grouping2,
           sum(birds) AS birds
    FROM panel LEFT JOIN species_groups USING (species) GROUP BY species, grouping""", ("panel", "species_groups"))
def group_override(t):
    own = {"NATION_3": "Eider", "NATION_5": "Loon"}
    summed = p.attach_groups(totals(t.panel, "species", name="birds"), t.species_groups)
    return summed.withColumn("grouping2", p.own_group(F.col("species"), F.col("grouping"), own))


@query("sentinel_null", """
    SELECT row_id, CASE WHEN txt IN ('', 'No Coverage') THEN NULL ELSE txt END AS txt,
           CASE WHEN regexp_matches(label, 'LOW') THEN NULL ELSE label END AS label FROM messy""", ("messy",))
def sentinel_null(t):
    return t.messy.select(
        "row_id", x.null_if_in(F.col("txt"), "", "No Coverage").alias("txt"),
        x.null_if_matches(F.col("label"), "LOW").alias("label"),
    )


_NUMBER = r"regexp_full_match(txt, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')"


@query("minutes_default", f"""
    SELECT row_id, CASE WHEN txt IN ('', 'No Coverage') THEN 0
                        WHEN {_NUMBER} THEN trunc(CAST(trim(txt) AS DOUBLE)) END AS minutes,
           CASE WHEN txt IN ('', 'No Coverage') OR NOT {_NUMBER} THEN 0
                ELSE CAST(trunc(CAST(trim(txt) AS DOUBLE)) AS INTEGER) END AS minutes_or_zero
    FROM messy""", ("messy",))
def minutes_default(t):
    zero = ("", "No Coverage")
    return t.messy.select(
        "row_id", n.parse_minutes(F.col("txt"), zero).cast("double").alias("minutes"),
        n.parse_minutes(F.col("txt"), zero, True).alias("minutes_or_zero"),
    )


@query("dirty_cast", f"""
    SELECT row_id, CASE WHEN {_NUMBER} THEN CAST(trim(txt) AS DOUBLE) ELSE 0 END AS kept,
           CASE WHEN {_NUMBER} THEN trunc(CAST(trim(txt) AS DOUBLE)) ELSE 0 END AS whole,
           CASE WHEN starts_with(txt, '1,') THEN CAST(replace(txt, ',', '') AS DOUBLE)
                WHEN {_NUMBER} THEN CAST(trim(txt) AS DOUBLE) ELSE 0 END AS stripped
    FROM messy""", ("messy",))
def dirty_cast(t):
    txt = F.col("txt")
    return t.messy.select(
        "row_id", n.parse_count(txt).alias("kept"), n.parse_count(txt, True).alias("whole"),
        n.parse_count(txt, thousands="strip").alias("stripped"),
    )


@query("filter_ne", """
    SELECT species, date, birds FROM panel WHERE year NOT IN (1995, 1996) AND species <> 'NATION_1' AND species <> 'NATION_2'""",
       ("panel",), dates=("date",))
def filter_ne(t):
    late = t.panel.filter((F.col("year") != 1995) & (F.col("year") != 1996))
    return late.filter((F.col("species") != "NATION_1") & (F.col("species") != "NATION_2")).select("species", "date", "birds")


@query("filter_notin", """
    SELECT species, sum(birds) AS birds FROM panel JOIN species_groups USING (species)
    WHERE grouping = 'EUROPE' AND species NOT IN ('NATION_3', 'NATION_8') GROUP BY species""", ("panel", "species_groups"))
def filter_notin(t):
    focal = p.attach_groups(t.panel, t.species_groups).filter("grouping = 'EUROPE'")
    return totals(p.without_labels(focal, ["NATION_3", "NATION_8"]), "species", name="birds")


@query("filter_regex", "SELECT species, sum(birds) AS birds FROM panel WHERE NOT regexp_matches(species, '(?i)n_.1') GROUP BY species",
       ("panel",))
def filter_regex(t):
    return totals(p.without_unidentified(t.panel, "(?i)n_.1"), "species", name="birds")


@query("drop_no_effort", "SELECT species, date, birds, CAST(total_obs_mins AS DOUBLE) AS total_obs_mins FROM panel_eff WHERE NOT (birds = 0 AND obs_hours = 0)",
       ("panel_eff",), dates=("date",))
def drop_no_effort(t):
    return p.drop_no_effort(t.panel_eff).select("species", "date", "birds", F.col("total_obs_mins").cast("double").alias("total_obs_mins"))


@query("complete_cases", """
    SELECT date, species, tsm, wind_dir, pressure, birds FROM panel JOIN days USING (date) WHERE tsm IS NOT NULL""",
       ("panel", "days"), dates=("date",))
def complete_cases(t):
    joined = p.attach_days(t.panel, t.days.select("date", "tsm", "wind_dir", "pressure"))
    return joined.dropna("any").select("date", "species", "tsm", "wind_dir", "pressure", "birds")


@query("semi_species", """
    SELECT species, period, birds FROM detect WHERE species IN (
      SELECT species FROM (SELECT species, period FROM detect GROUP BY ALL HAVING sum(birds) > 0)
      GROUP BY species HAVING count(*) = (SELECT count(DISTINCT period) FROM detect))""", ("detect",))
def semi_species(t):
    return p.in_species(t.detect, seen_every_period(t.detect, "period")).select("species", "period", "birds")


@query("distinct_days", "SELECT DISTINCT date, total_obs_mins FROM panel_eff WHERE total_obs_mins > 0", ("panel_eff",), dates=("date",))
def distinct_days(t):
    return t.panel_eff.filter("total_obs_mins > 0").select("date", "total_obs_mins").distinct()


@query("factor_levels", """
    SELECT year, CAST(list_position([1996, 1997, 1998, 1999, 2000], year) AS DOUBLE) AS level, sum(birds) AS birds
    FROM panel GROUP BY year""", ("panel",))
def factor_levels(t):
    summed = totals(t.panel, "year", name="birds")
    return summed.withColumn("level", factor_code(F.col("year"), [1996, 1997, 1998, 1999, 2000]).cast("double"))


@query("join_effort", "SELECT species, date, birds, CAST(total_obs_mins AS DOUBLE) AS total_obs_mins, observer FROM panel_eff", ("panel_eff",), dates=("date",))
def join_effort(t):
    return p.attach_days(t.panel, t.effort).select(
        "species", "date", "birds", F.col("total_obs_mins").cast("double").alias("total_obs_mins"), "observer"
    )


_EXTRA = """
    SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS start_time, NULL AS score
    FROM orders WHERE o_orderdate < '1998-01-01'
    UNION ALL
    SELECT CAST(strptime(strftime(o_orderdate, '%-m/%-d/%y'), '%-m/%-d/%y') AS DATE), o_orderpriority,
           CAST(count(*) AS VARCHAR)
    FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY ALL"""


def _extra(t):
    orders = t.base("orders")
    day = F.col("o_orderdate").cast("date").alias("date")
    older = orders.filter("o_orderdate < '1998-01-01'").select(day, F.col("o_orderpriority").alias("start_time"))
    typed = F.date_format("o_orderdate", "M/d/yy")
    newer = orders.filter("o_orderdate >= '1998-01-01'").groupBy(
        typed.alias("typed"), F.col("o_orderpriority").alias("start_time")
    ).agg(F.count("*").cast("string").alias("score"))
    newer = newer.select(d.parse_us_date(F.col("typed")).alias("date"), "start_time", "score")
    return tables.union_hand_edits(older, newer)


@query("extra_union", _EXTRA, dates=("date",))
def extra_union(t):
    return _extra(t)


@query("join_extra", f"""WITH extra AS ({_EXTRA})
    SELECT species, date, birds, start_time, score FROM panel LEFT JOIN extra USING (date)""", ("panel",), dates=("date",))
def join_extra(t):
    return p.attach_hand_edits(t.panel, settle(_extra(t), "edits")).select("species", "date", "birds", "start_time", "score")


@query("join_groups", """
    SELECT grouping, year, sum(birds) AS birds FROM panel LEFT JOIN species_groups USING (species) GROUP BY grouping, year""",
       ("panel", "species_groups"))
def join_groups(t):
    return totals(p.attach_groups(t.panel, t.species_groups), "grouping", "year", name="birds")


@query("union_years", """
    SELECT species, date, birds, CASE WHEN year >= 2000 THEN obs_hours END AS obs_hours,
           CASE WHEN year >= 2000 THEN observer END AS observer
    FROM panel_eff""", ("panel_eff",), dates=("date",))
def union_years(t):
    """Early seasons lack the derived columns; they come out NULL."""
    early = t.panel.filter(F.col("year") < 2000).select("species", "date", "birds")
    late = t.panel_eff.filter(F.col("year") >= 2000).select("species", "date", "birds", "obs_hours", "observer")
    return p.union_seasons([early, late])


@query("scalar_strings", r"""
    SELECT row_id, replace(lower(label), ' ', '.') AS dotted, regexp_replace(label, '-', '') AS first_removed,
           regexp_replace(txt, '\d', '#') AS first_replaced, regexp_replace(txt, '\d', '#', 'g') AS all_replaced,
           regexp_extract(label, '^\w*') AS word, regexp_extract(trim(txt), '^\d*') AS digits,
           regexp_replace(label, '^(\d)[[:punct:]]', '0\1:') AS clock,
           label || '; ' || nullif(txt, '') AS pasted, contains(label, 'HIGH') AS has_high,
           CASE WHEN contains(label, 'LOW') THEN NULL ELSE label END AS not_low
    FROM messy""", ("messy",))
def scalar_strings(t):
    label, txt = F.col("label"), F.col("txt")
    return t.messy.select(
        "row_id", x.dotted_label(label).alias("dotted"), x.strip_first(label, "-").alias("first_removed"),
        x.replace_first(txt, r"\d", "#").alias("first_replaced"), F.regexp_replace(txt, r"\d", "#").alias("all_replaced"),
        x.leading_word(label).alias("word"), x.leading_digits(F.trim(txt)).alias("digits"), x.pad_clock(label).alias("clock"),
        F.concat(label, F.lit("; "), x.null_if_in(txt, "")).alias("pasted"), label.rlike("HIGH").alias("has_high"),
        x.null_if_matches(label, "LOW").alias("not_low"),
    )


@query("scalar_dates", """
    SELECT row_id, CAST(strptime(strftime(date, '%-m/%-d/%y'), '%-m/%-d/%y') AS DATE) AS parsed,
           CAST(year(date) AS INTEGER) AS y, CAST(month(date) AS INTEGER) AS m, CAST(day(date) AS INTEGER) AS dd,
           CAST(dayofyear(date) AS INTEGER) AS doy, make_date(2000, month(date), day(date)) AS season,
           strftime(DATE '2020-01-01' + CAST(dayofyear(date) AS INTEGER), '%b-%d') AS label
    FROM messy""", ("messy",), dates=("parsed", "season"))
def scalar_dates(t):
    date = F.col("date")
    typed = F.when(F.col("row_id") % 2 == 0, F.date_format(date, "M-d-yy")).otherwise(F.date_format(date, "MM/dd/yyyy"))
    return t.messy.select(
        "row_id", d.parse_us_date(typed).alias("parsed"), F.year(date).alias("y"), F.month(date).alias("m"),
        F.dayofmonth(date).alias("dd"), F.dayofyear(date).alias("doy"), d.season_date(date).alias("season"),
        d.day_label(F.dayofyear(date)).alias("label"),
    )


@query("scalar_times", """
    SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, CAST(ts AS DATE) AS day,
           round(hour(ts) + minute(ts) / 60.0::DOUBLE, 6) AS hours,
           date_trunc('second', ts) - INTERVAL 5 HOUR AS local_time
    FROM events""", dates=("day", "local_time"))
def scalar_times(t):
    """Clock text, local day, hours since midnight, and UTC text to New York wall time (winter: five hours back)."""
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.base("events").select(
        "event_id", d.time_text(ts).alias("clock"), ts.cast("date").alias("day"),
        F.round(d.clock_hours(F.date_format(ts, "H:mm")), 6).alias("hours"),
        d.local_wall_time(text, "America/New_York").alias("local_time"),
    )


@query("scalar_math", """
    SELECT row_id, round(sin(radians(row_id % 360)), 6) AS s, round(cos(row_id % 360), 6) AS c,
           round(fmod(degrees(atan2(row_id % 7 - 3, row_id % 5 - 2)) + 360, 360), 6) AS bearing,
           round_even((row_id % 1000) / 8.0::DOUBLE, 2) AS half_even, round(ln(row_id % 100 + 1), 6) AS log1,
           round((row_id % 13) / nullif(row_id % 4, 0), 6) AS safe_ratio,
           CAST((row_id % 9) * (row_id % 9) AS DOUBLE) AS squared
    FROM messy""", ("messy",))
def scalar_math(t):
    k = F.col("row_id")
    turn = F.degrees(F.atan2((k % 7 - 3).cast("double"), (k % 5 - 2).cast("double"))) + 360.0
    return t.messy.select(
        "row_id", F.round(F.sin(F.radians(k % 360)), 6).alias("s"), F.round(F.cos(k % 360), 6).alias("c"),
        F.round(F.pmod(turn, F.lit(360.0)), 6).alias("bearing"), F.bround(k % 1000 / F.lit(8.0), 2).alias("half_even"),
        F.round(F.log1p((k % 100).cast("double")), 6).alias("log1"), F.round(n.ratio(k % 13, k % 4), 6).alias("safe_ratio"),
        F.pow(k % 9, F.lit(2)).alias("squared"),
    )


@query("effect_format", """
    WITH e AS (SELECT species, sum(birds) AS tot, avg(birds) AS mean, count(*) AS n FROM panel GROUP BY species),
    r AS (SELECT species, round_even(mean / 7, 2) AS est, round_even(tot / n - 4, 2) AS lo, CAST(n AS DOUBLE) AS hi FROM e)
    SELECT species, printf('%g', est) || ' (' || printf('%g', lo) || ' to ' || CAST(CAST(hi AS BIGINT) AS VARCHAR) || ')' AS effect FROM r""",
       ("panel",))
def effect_format(t):
    e = t.panel.groupBy("species").agg(F.avg("birds").alias("mean"), F.count("*").alias("n"))
    return e.select("species", n.effect_text(F.col("mean") / 7, F.col("mean") - 4, F.col("n").cast("double")).alias("effect"))


@query("species_top_day", """
    SELECT species, date, birds FROM (SELECT species, date, sum(birds) AS birds FROM panel GROUP BY species, date)
    ORDER BY birds DESC, species, date LIMIT 20""", ("panel",), dates=("date",))
def species_top_day(t):
    return top(p.collapse_duplicates(t.panel), 20, "birds", "species", "date")
