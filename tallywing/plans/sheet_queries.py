"""Reading, slicing and reshaping wide sheets; sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywing.functions.dates import parse_us_date
from tallywing.functions.numbers import parse_count, parse_minutes
from tallywing.functions.text import join_present
from tallywing.operators.panel import collapse_duplicates
from tallywing.plans.catalog import query
from tallywing.session import scratch_path
from tallywing.sources import sheets, tables
from tallywing.sources.layouts import ENVIRONMENT_COLUMNS, ENVIRONMENT_NAMES, ZERO_MINUTES


def _bands(t):
    return sheets.band_rows(t.sheet, F.lit("Visibility"), F.lit("Total"))


def _headers(t):
    return sheets.header_cells(t.sheet, drop=F.col("header").isin("Species Totals"))


_BANDS = """
    SELECT file, row_idx, label, CASE WHEN row_idx <= 3 THEN 'environment' WHEN row_idx < 900 THEN 'species' ELSE 'footer' END AS band
    FROM sheet WHERE row_idx > 0 AND label <> ''"""
_LONG = """
    SELECT r.file, r.row_idx, r.label, h.header, r.cells[h.pos] AS cell
    FROM sheet r JOIN (SELECT file, cells[p] AS header, p AS pos FROM sheet, (SELECT unnest(range(1, 13)) AS p) WHERE row_idx = 0) h
    USING (file)"""


@query("sheet_skip", """
    SELECT file, CAST(row_idx - 1 AS INTEGER) AS row_idx, label, array_to_string(cells, '|') AS cells
    FROM sheet WHERE row_idx >= 1""", ("sheet",))
def sheet_skip(t):
    return sheets.skip_preamble(t.sheet, 1).withColumn("cells", F.array_join("cells", "|"))


@query("sheet_read_back", """
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY row_idx) - 1 AS INTEGER) AS row_idx, label,
           array_to_string(cells, '|') AS cells
    FROM sheet WHERE row_idx > 0""", ("sheet",))
def sheet_read_back(t):
    """Sheets written as CSV, then read by the sheet reader with the first line as preamble."""
    path = scratch_path(t.spark, "sheets")
    flat = t.sheet.select("file", "row_idx", "label", *[F.get("cells", i).alias(f"c{i}") for i in range(13)])
    ordered = flat.repartition("file").sortWithinPartitions("file", "row_idx").drop("row_idx")
    ordered.withColumn("sheet_file", F.col("file")).drop("file").write.partitionBy("sheet_file").option("emptyValue", "").csv(path)
    back = sheets.skip_preamble(sheets.read_sheets(t.spark, f"{path}/*/*.csv"), 1)
    return back.select(
        F.regexp_extract("file", r"sheet_file=(\d+)", 1).alias("file"), "row_idx", "label",
        F.array_join(F.slice("cells", 1, 13), "|").alias("cells"),
    )


@query("sheet_bands", _BANDS, ("sheet",))
def sheet_bands(t):
    return _bands(t).select("file", "row_idx", "label", "band")


@query("sheet_header_fix", """
    SELECT file, p AS pos, CASE WHEN cells[p + 1] = '10/1/95' THEN '11/1/95' ELSE cells[p + 1] END AS header
    FROM sheet, (SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS p)
    WHERE row_idx = 0 AND cells[p + 1] <> 'Species Totals'""", ("sheet",))
def sheet_header_fix(t):
    def fix(header):
        return F.when(header == "10/1/95", F.lit("11/1/95")).otherwise(header)

    return sheets.header_cells(t.sheet, F.col("header") == "Species Totals", fix).select("file", "pos", "header")


@query("sheet_unpivot", f"""
    SELECT l.label AS species, try_strptime(replace(header, '/', '-'), '%-m-%-d-%y')::DATE AS date,
           coalesce(try_cast(cell AS DOUBLE), 0) AS birds
    FROM ({_LONG}) l WHERE row_idx BETWEEN 10 AND 899""", ("sheet",), dates=("date",))
def sheet_unpivot(t):
    long = sheets.unpivot_cells(_bands(t).filter("band = 'species'"), _headers(t))
    return long.select(
        F.col("label").alias("species"), parse_us_date(F.col("header")).alias("date"), parse_count(F.col("cell")).alias("birds")
    )


@query("env_pivot", f"""
    SELECT file, header, max(CASE WHEN label = 'Minutes of Observation' THEN cell END) AS total_obs_mins,
           max(CASE WHEN label = 'Principle Observer' THEN cell END) AS observer,
           max(CASE WHEN label = 'Visibility' THEN cell END) AS visibility
    FROM ({_LONG}) WHERE row_idx BETWEEN 1 AND 3 GROUP BY file, header""", ("sheet",))
def env_pivot(t):
    long = sheets.unpivot_cells(_bands(t).filter("band = 'environment'"), _headers(t))
    wide = sheets.environment_table(long, ENVIRONMENT_NAMES, ENVIRONMENT_COLUMNS)
    return wide.select("file", "header", "total_obs_mins", "observer", "visibility")


@query("sheet_panel", f"""WITH l AS ({_LONG}),
    c AS (SELECT file, header, label AS species, coalesce(try_cast(cell AS DOUBLE), 0) AS birds FROM l WHERE row_idx BETWEEN 10 AND 899),
    e AS (SELECT file, header, CASE WHEN cell IN ('', 'No Coverage') THEN 0 ELSE CAST(cell AS INTEGER) END AS mins FROM l WHERE row_idx = 1)
    SELECT species, try_strptime(replace(header, '/', '-'), '%-m-%-d-%y')::DATE AS date, mins AS total_obs_mins, birds,
           round(birds / nullif(mins / 60.0::DOUBLE, 0), 6) AS birds_per_hour
    FROM c JOIN e USING (file, header)""", ("sheet",), dates=("date",))
def sheet_panel(t):
    """From a wide sheet to counts with effort: slice, unpivot both bands, cast, join."""
    from tallywing.operators.panel import attach_days, derive_rates

    rows, headers = _bands(t), _headers(t)
    effort = sheets.environment_table(
        sheets.unpivot_cells(rows.filter("band = 'environment'"), headers), ENVIRONMENT_NAMES, ENVIRONMENT_COLUMNS
    ).select(
        parse_us_date(F.col("header")).alias("date"), parse_minutes(F.col("total_obs_mins"), ZERO_MINUTES).alias("total_obs_mins")
    )
    joined = attach_days(sheet_unpivot(t), effort)
    return derive_rates(joined).select(
        "species", "date", "total_obs_mins", "birds", F.round("birds_per_hour", 6).alias("birds_per_hour")
    )


@query("concat_nullsafe", f"""
    SELECT file, header, nullif(concat_ws('; ', nullif(max(CASE WHEN row_idx = 1 THEN cell END), ''),
                                               nullif(max(CASE WHEN row_idx = 2 THEN cell END), '')), '') AS time_of_obs
    FROM ({_LONG}) GROUP BY file, header""", ("sheet",))
def concat_nullsafe(t):
    """Two rows of times merged into one text without the missing parts."""
    wide = env_pivot(t)
    first, second = (F.when(F.col(c) != "", F.col(c)) for c in ("total_obs_mins", "observer"))
    return wide.select("file", "header", join_present("; ", first, second).alias("time_of_obs"))


@query("pivot_species_year", """
    SELECT species, sum(birds) FILTER (year = 1995) AS "1995", sum(birds) FILTER (year = 1996) AS "1996",
           sum(birds) FILTER (year = 1997) AS "1997", sum(birds) FILTER (year = 1998) AS "1998",
           sum(birds) FILTER (year = 1999) AS "1999", sum(birds) FILTER (year = 2000) AS "2000",
           sum(birds) FILTER (year = 2001) AS "2001"
    FROM panel GROUP BY species""", ("panel",))
def pivot_species_year(t):
    from tallywing.operators.summary import species_by_year

    years = [r["year"] for r in t.panel.select("year").distinct().orderBy("year").collect()]  # a column a year
    return species_by_year(t.panel, years)


@query("sink_roundtrip", "SELECT species, date, year, sum(birds) AS birds FROM panel GROUP BY ALL", ("panel",), dates=("date",))
def sink_roundtrip(t):
    """The panel through the Parquet sink, partitioned by year."""
    path = scratch_path(t.spark, "panel")
    tables.write_panel(collapse_duplicates(t.panel, ["species", "date", "year"]), path)
    return t.spark.read.parquet(path).select("species", "date", "year", "birds")


@query("sink_replace_seasons", """
    SELECT species, date, year, sum(birds * CASE WHEN year % 2 = 0 THEN 2 ELSE 1 END) AS birds FROM panel GROUP BY species, date, year""",
       ("panel",), dates=("date",))
def sink_replace_seasons(t):
    """The panel written twice to one table, the second time with half of its seasons, their counts doubled: the others stay untouched."""
    path = scratch_path(t.spark, "seasons")
    rows = collapse_duplicates(t.panel, ["species", "date", "year"])
    tables.replace_seasons(rows, path)
    tables.replace_seasons(rows.filter("year % 2 = 0").withColumn("birds", F.col("birds") * 2), path)
    return t.spark.read.parquet(path).select("species", "date", "year", "birds")


@query("sink_csv_roundtrip", "SELECT species, year, sum(birds) AS birds FROM panel GROUP BY ALL", ("panel",))
def sink_csv_roundtrip(t):
    """Yearly totals through the CSV sink."""
    path = scratch_path(t.spark, "totals")
    tables.write_csv(collapse_duplicates(t.panel, ["species", "year"]), path)
    return tables.read_lookup(t.spark, path, "species string, year int, birds double")
