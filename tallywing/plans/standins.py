"""Test-table stand-ins for the survey's inputs, once as DataFrames and once as SQL.

The driver's tables hold no birds, so shipments play the counts (supplier nation = species, ship
date = day), orders play the effort rows, and events play the weather station. Both definitions
give the same rows, so each query can be checked against plain SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.functions.numbers import ratio
from tallywing.operators.panel import attach_days, covariates, drop_no_effort, model_frame
from tallywing.operators.scaling import TERMS, with_terms
from tallywing.session import settle

MONTHS = list(range(1, 13))
GIVEN_SLOPES = [0.05, -0.1, 0.2, -0.15, 0.1, -0.05, 0.02, -0.03, 0.25]


class Tables:
    """Base tables and stand-ins for one data folder; each is built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def panel(self) -> DataFrame:
        """Counts: ``(species, date, year, birds)``.

        No side is hinted: the supplier table grows with the data. The joins run left to right, so that
        each side is a plain scan whose size Catalyst knows from its files.
        """
        items = self.base("lineitem").select(
            "l_suppkey", F.col("l_shipdate").cast("date").alias("date"),
            F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("birds"),
        )
        suppliers = self.base("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        nations = self.base("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("species"))
        joined = items.join(suppliers, "l_suppkey").join(nations, "s_nationkey")
        return joined.select("species", "date", F.year("date").alias("year"), "birds")

    @cached_property
    def days(self) -> DataFrame:
        """One row per day: effort, observer and weather, from the orders placed that day."""
        n, code = F.count("*"), F.sum(F.col("o_custkey") % 1000)
        return self.base("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
            (n % 5 * 50).cast("int").alias("total_obs_mins"),
            (n % 5 * 50 / F.lit(60.0)).alias("obs_hours"),
            F.when(code % 9 != 8, F.concat(F.lit("OB"), (code % 5).cast("string"))).alias("observer"),
            F.when(n % 7 != 0, 4 + F.avg(F.col("o_orderkey") % 24) / 4).alias("tsm"),
            F.avg(F.col("o_custkey") % 23).alias("wind_speed"),
            (code * 37 % 360).cast("double").alias("wind_dir"),
            (1000 + F.sum(F.col("o_orderkey") % 1000) % 41).cast("double").alias("pressure"),
        )

    @cached_property
    def effort(self) -> DataFrame:
        return self.days.select("date", "total_obs_mins", "obs_hours", "observer")

    @cached_property
    def panel_eff(self) -> DataFrame:
        return attach_days(self.panel, self.effort).select(
            "species", "date", "year", "birds", "total_obs_mins", "obs_hours", "observer",
            ratio(F.col("birds"), F.col("obs_hours")).alias("birds_per_hour"),
        )

    @cached_property
    def detect(self) -> DataFrame:
        """Counts per supplier and year, for the seen-in-every-period rule; a supplier whose number ends like a year has a gap there."""
        year = F.year("l_shipdate")
        gap = F.col("l_suppkey") % 10 == year % 10
        return self.base("lineitem").groupBy(
            F.col("l_suppkey").alias("species"), year.cast("string").alias("period")
        ).agg(F.sum(F.when(~gap, F.col("l_quantity")).otherwise(0.0)).alias("birds"))

    @cached_property
    def wx(self) -> DataFrame:
        return self.base("events").select(
            F.col("ts").alias("datetime"), F.col("ts").cast("date").alias("date"),
            F.col("value").alias("wind_speed"),
            (F.col("event_id") * 37 % 360).cast("double").alias("wind_direction"),
            F.when(F.col("user_id") % 11 != 0, (1000 + F.col("user_id") % 30).cast("double")).alias("pressure"),
        )

    @cached_property
    def wx_dates(self) -> DataFrame:
        bought = self.base("events").filter("event_type = 'purchase'")
        return bought.groupBy(F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("birds"))

    @cached_property
    def species_groups(self) -> DataFrame:
        nations, regions = self.base("nation"), self.base("region")
        joined = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"])
        return joined.select(F.col("n_name").alias("species"), F.col("r_name").alias("grouping"))

    @cached_property
    def species_meta(self) -> DataFrame:
        return self.base("nation").select(
            F.col("n_name").alias("species"), F.upper(F.concat(F.lit("avis "), "n_name")).alias("sci_name")
        )

    @cached_property
    def messy(self) -> DataFrame:
        """Dirty number texts, one per order: plain, starred, with a comma, decimal, blank or words."""
        key, cents = F.col("o_orderkey"), F.col("o_orderkey") % 997
        text = (
            F.when(key % 8 == 0, F.concat(cents.cast("string"), F.lit("*")))
            .when(key % 8 == 1, F.concat(F.lit("1,"), F.lpad(cents.cast("string"), 3, "0")))
            .when(key % 8 == 2, F.concat(cents.cast("string"), F.lit(".7")))
            .when(key % 8 == 3, F.lit(""))
            .when(key % 8 == 4, F.lit("No Coverage"))
            .when(key % 8 == 5, F.concat(F.lit(" "), cents.cast("string"), F.lit(" ")))
            .when(key % 8 == 6, F.concat(cents.cast("string"), F.lit("d")))
            .otherwise(cents.cast("string"))
        )
        return self.base("orders").select(
            F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), text.alias("txt"),
            F.col("o_orderdate").cast("date").alias("date"),
        )

    @cached_property
    def sheet(self) -> DataFrame:
        """One wide sheet per year: header, effort, marker, blank, species and total rows, months as cells."""
        year = F.col("year").cast("string")

        def row(file, idx, label, cells):
            return [file.alias("file"), idx.cast("int").alias("row_idx"), label.alias("label"), cells.alias("cells")]

        month = F.month("date")
        # A sheet is a file somebody typed: it is written once, so that the steps on it read a page and
        # not the shipments.
        counts = settle(self.panel.groupBy("species", "year").agg(
            *[F.sum(F.when(month == m, F.col("birds"))).cast("bigint").alias(f"m{m}") for m in MONTHS],
            F.sum("birds").cast("bigint").alias("m13"),
        ), "sheet")
        cells = F.array(*[_dirty_cell(F.col(f"m{m}")) for m in [*MONTHS, 13]])
        species = counts.select(*row(
            year, 10 + F.regexp_extract("species", r"(\d+)$", 1).cast("int"), F.col("species"), cells
        ))
        blank = F.array_repeat(F.lit(""), 13)
        tops = counts.select("year").distinct().withColumn("r", F.explode(F.lit([0, 1, 2, 3, 4, 900, 901])))
        head = F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat(
                m.cast("string"), F.when(m % 2 == 0, F.lit("/1/")).otherwise(F.lit("-1-")), F.substring(year, 3, 2)
            )), F.array(F.lit("Species Totals")),
        )
        minutes = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda m: (
            F.when((m + F.col("year")) % 4 == 0, F.lit("No Coverage"))
            .when((m + F.col("year")) % 4 == 1, F.lit(""))
            .otherwise((m * 60 + F.col("year") % 10).cast("string"))
        ))
        seen = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda m: F.concat(m.cast("string"), F.lit(" miles")))
        r = F.col("r")
        label = (
            F.when(r == 0, "Date").when(r == 1, "Minutes of Observation").when(r == 2, "Principle Observer")
            .when(r == 3, "Visibility").when(r == 4, "").when(r == 900, "Total").otherwise("Notes")
        )
        top_cells = F.when(r == 0, head).when(r == 1, minutes).when(r == 3, seen).otherwise(blank)
        return settle(tops.select(*row(year, r, label, top_cells)).unionByName(species), "sheets")

    @cached_property
    def frame(self) -> DataFrame:
        """Model frame: one complete row per day and species."""
        joined = attach_days(self.panel, self.days)
        return model_frame(covariates(drop_no_effort(joined)))


    @cached_property
    def stored_frame(self) -> DataFrame:
        """The model frame, written once for the jobs that read it more than once."""
        return settle(self.frame, "frame")

    @cached_property
    def scaled(self) -> DataFrame:
        """Model frame with standardised terms."""
        return with_terms(self.stored_frame)

    @cached_property
    def given(self) -> DataFrame:
        """Coefficients to check effects and diagnostics against: intercept at the log mean, fixed
        slopes, a diagonal covariance, theta 1.5. Shaped like the result of a fit."""
        size = len(TERMS) + 1
        cells = [F.lit(0.0)] * (size * size)
        for i in range(size):
            cells[i * size + i] = F.lit((i + 1.0) * 4) / F.col("n")
        means = self.stored_frame.groupBy("species").agg(F.avg("birds").alias("mean"), F.count("*").alias("n")).filter("mean > 0")
        return means.select(
            F.col("species").alias("group"), F.lit("nbinom").alias("family"), F.lit((1 << len(TERMS)) - 1).alias("mask"),
            F.lit(size + 1).alias("k"), "n", F.array(F.log("mean"), *[F.lit(b) for b in GIVEN_SLOPES]).alias("beta"),
            F.log(F.lit(1.5)).alias("log_theta"), F.lit(None).cast("double").alias("zeta"), F.array(*cells).alias("vcov"),
        )


def _dirty_cell(n):
    """A month's count as typed: blank when missing, with a comma or a star now and then."""
    return (
        F.when(n.isNull(), F.lit(""))
        .when(n % 7 == 0, F.concat(n.cast("string"), F.lit("*")))
        .when((n % 7 == 1) & (n >= 1000), F.format_number(n, 0))
        .otherwise(n.cast("string"))
    )


_CELL = (
    "CASE WHEN {n} IS NULL THEN '' WHEN {n} % 7 = 0 THEN CAST({n} AS VARCHAR) || '*' "
    "WHEN {n} % 7 = 1 AND {n} >= 1000 THEN format('{{:,}}', {n}) ELSE CAST({n} AS VARCHAR) END"
)
_MONTH_SUMS = ", ".join(f"CAST(sum(CASE WHEN month(date) = {m} THEN birds END) AS BIGINT) AS m{m}" for m in MONTHS)
_MONTH_CELLS = ", ".join(_CELL.format(n=f"m{m}") for m in MONTHS)
_YEAR_TOTAL = "(" + " + ".join(f"coalesce(m{m}, 0)" for m in MONTHS) + ")"

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "panel": ((), """
        SELECT n.n_name AS species, CAST(l.l_shipdate AS DATE) AS date, CAST(year(l.l_shipdate) AS INTEGER) AS year,
               CASE WHEN l.l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l.l_quantity END AS birds
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey"""),
    "days": ((), """
        SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) % 5 * 50 AS INTEGER) AS total_obs_mins,
               CAST(count(*) % 5 * 50 AS DOUBLE) / 60.0::DOUBLE AS obs_hours, CASE WHEN sum(o_custkey % 1000) % 9 <> 8 THEN 'OB' || CAST(CAST(sum(o_custkey % 1000) % 5 AS BIGINT) AS VARCHAR) END AS observer,
               CASE WHEN count(*) % 7 <> 0 THEN 4 + avg(o_orderkey % 24) / 4 END AS tsm,
               avg(o_custkey % 23) AS wind_speed,
               CAST(sum(o_custkey % 1000) * 37 % 360 AS DOUBLE) AS wind_dir,
               CAST(1000 + sum(o_orderkey % 1000) % 41 AS DOUBLE) AS pressure
        FROM orders GROUP BY 1"""),
    "effort": (("days",), "SELECT date, total_obs_mins, obs_hours, observer FROM days"),
    "panel_eff": (("panel", "effort"), """
        SELECT p.species, p.date, p.year, p.birds, e.total_obs_mins, e.obs_hours, e.observer,
               p.birds / nullif(e.obs_hours, 0) AS birds_per_hour
        FROM panel p LEFT JOIN effort e USING (date)"""),
    "detect": ((), """
        SELECT l_suppkey AS species, strftime(l_shipdate, '%Y') AS period,
               sum(CASE WHEN l_suppkey % 10 <> year(l_shipdate) % 10 THEN l_quantity ELSE 0 END) AS birds
        FROM lineitem GROUP BY ALL"""),
    "wx": ((), """
        SELECT ts AS datetime, CAST(ts AS DATE) AS date, value AS wind_speed,
               CAST(event_id * 37 % 360 AS DOUBLE) AS wind_direction,
               CASE WHEN user_id % 11 <> 0 THEN CAST(1000 + user_id % 30 AS DOUBLE) END AS pressure
        FROM events"""),
    "wx_dates": ((), "SELECT CAST(ts AS DATE) AS date, count(*) AS birds FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "species_groups": ((), "SELECT n_name AS species, r_name AS grouping FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "species_meta": ((), "SELECT n_name AS species, upper('avis ' || n_name) AS sci_name FROM nation"),
    "messy": ((), """
        SELECT o_orderkey AS row_id, o_orderpriority AS label,
               CASE o_orderkey % 8
                 WHEN 0 THEN CAST(o_orderkey % 997 AS VARCHAR) || '*'
                 WHEN 1 THEN '1,' || lpad(CAST(o_orderkey % 997 AS VARCHAR), 3, '0')
                 WHEN 2 THEN CAST(o_orderkey % 997 AS VARCHAR) || '.7'
                 WHEN 3 THEN ''
                 WHEN 4 THEN 'No Coverage'
                 WHEN 5 THEN ' ' || CAST(o_orderkey % 997 AS VARCHAR) || ' '
                 WHEN 6 THEN CAST(o_orderkey % 997 AS VARCHAR) || 'd'
                 ELSE CAST(o_orderkey % 997 AS VARCHAR) END AS txt,
               CAST(o_orderdate AS DATE) AS date
        FROM orders"""),
    "sheet": (("panel",), f"""
        SELECT CAST(year AS VARCHAR) AS file, CAST(10 + CAST(regexp_extract(species, '(\\d+)$', 1) AS INTEGER) AS INTEGER) AS row_idx,
               species AS label, [{_MONTH_CELLS}, {_CELL.format(n=_YEAR_TOTAL)}] AS cells
        FROM (SELECT species, year, {_MONTH_SUMS} FROM panel GROUP BY species, year)
        UNION ALL
        SELECT CAST(year AS VARCHAR), r,
               CASE r WHEN 0 THEN 'Date' WHEN 1 THEN 'Minutes of Observation' WHEN 2 THEN 'Principle Observer'
                      WHEN 3 THEN 'Visibility' WHEN 4 THEN '' WHEN 900 THEN 'Total' ELSE 'Notes' END,
               CASE r
                 WHEN 0 THEN [CASE WHEN m = 13 THEN 'Species Totals' WHEN m % 2 = 0 THEN m || '/1/' || substr(CAST(year AS VARCHAR), 3, 2)
                              ELSE m || '-1-' || substr(CAST(year AS VARCHAR), 3, 2) END FOR m IN range(1, 14)]
                 WHEN 1 THEN [CASE WHEN (m + year) % 4 = 0 THEN 'No Coverage' WHEN (m + year) % 4 = 1 THEN ''
                              ELSE CAST(m * 60 + year % 10 AS VARCHAR) END FOR m IN range(1, 14)]
                 WHEN 3 THEN [m || ' miles' FOR m IN range(1, 14)]
                 ELSE ['' FOR m IN range(1, 14)] END
        FROM (SELECT DISTINCT year FROM panel) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 900, 901]) AS r)"""),
    "frame": (("panel", "days"), """
        SELECT p.date, p.year, CAST(dayofyear(p.date) AS INTEGER) AS doy, d.tsm, p.species, d.total_obs_mins, d.obs_hours,
               d.wind_speed, cos(d.wind_dir) AS wind_dir_cos, sin(d.wind_dir) AS wind_dir_sin, d.pressure, d.observer,
               sum(p.birds) AS birds
        FROM panel p JOIN days d USING (date)
        WHERE NOT (p.birds = 0 AND d.obs_hours = 0) AND d.tsm IS NOT NULL AND d.observer IS NOT NULL
        GROUP BY ALL"""),
}


_PLAIN = [t for t in TERMS if t != "doy2"]
_GIVEN = ", ".join(f"{b}::DOUBLE AS b{i + 1}" for i, b in enumerate(GIVEN_SLOPES))
_VARIANCES = ", ".join(f"{(i + 1) * 4}::DOUBLE / count(*) AS v{i}" for i in range(len(TERMS) + 1))
ETA_SQL = "(b0 + " + " + ".join(f"b{i + 1} * z_{t}" for i, t in enumerate(TERMS)) + ")"

SQL_VIEWS["scaled"] = (("frame",), """
        SELECT *, z_doy * z_doy AS z_doy2 FROM (SELECT *, """ + ", ".join(
            f"coalesce(({t} - avg({t}) OVER w) / nullif(stddev_samp({t}) OVER w, 0), 0) AS z_{t}, "
            f"avg({t}) OVER w AS mean_{t}, stddev_samp({t}) OVER w AS sd_{t}" for t in _PLAIN
        ) + " FROM frame WINDOW w AS (PARTITION BY species))")
SQL_VIEWS["given"] = (("frame",), f"""
        SELECT species, count(*) AS n, ln(avg(birds)) AS b0, {_GIVEN}, {_VARIANCES}, 1.5::DOUBLE AS theta
        FROM frame GROUP BY species HAVING avg(birds) > 0""")
SQL_VIEWS["fitted"] = (("scaled", "given"), f"""
        SELECT *, mu + mu * mu / theta AS variance, (birds - mu) / sqrt(mu + mu * mu / theta) AS e,
               pow(theta / (theta + mu), theta) AS p_zero
        FROM (SELECT s.*, g.* EXCLUDE (species), exp({ETA_SQL}) AS mu FROM scaled s JOIN given g USING (species))""")


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the stand-ins it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in SQL_VIEWS[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for view in views:
        visit(view)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name][1]})" for name in order)
    body = sql.strip()
    starts = re.match(r"WITH\s+(RECURSIVE\s)?", body, re.IGNORECASE)
    if starts:
        return f"WITH {starts[1] or ''}{ctes},\n{body[starts.end():]}"
    return f"WITH {ctes}\n{body}"
