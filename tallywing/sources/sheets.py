"""Wide survey sheets to long tables.

A sheet has a label column and one column per survey day, in three bands: environment rows on top,
species rows below, totals and notes at the foot. Every step works on rows of
``(file, row_idx, label, cells)`` for all sheets at once; scale comes from many sheets, as one sheet
is a page somebody typed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_COLUMNS = 256


def read_sheets(spark: SparkSession, path: str | list[str], max_columns: int = MAX_COLUMNS) -> DataFrame:
    """All sheets under ``path`` as ``(file, row_idx, label, cells)``, nothing cast or renamed.

    No header is taken from the file, since names repeat and differ by sheet. Quoted cells may hold
    newlines, so a file is read by one task in order. The schema is explicit because a glob read
    would take its width from one file and cut the wider ones; a row wider than ``max_columns``
    fails instead of losing cells.
    """
    names = [f"c{i}" for i in range(max_columns)]
    raw = (
        spark.read.schema(", ".join(f"{n} string" for n in names))
        .option("header", False).option("multiLine", True).option("escape", '"')
        .option("encoding", "UTF-8").option("maxColumns", max_columns)
        .csv(path)
    )
    located = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("seq"),
        F.regexp_replace("c0", "^﻿", "").alias("label"),
        F.array(*[F.coalesce(n, F.lit("")) for n in names[1:]]).alias("cells"),
    )
    order = Window.partitionBy("file").orderBy("seq")
    return located.select(
        "file", (F.row_number().over(order) - 1).alias("row_idx"), F.coalesce("label", F.lit("")).alias("label"), "cells"
    )


def skip_preamble(sheet: DataFrame, skip: Column | int) -> DataFrame:
    """Drop the first ``skip`` lines of every sheet and number the rest from 0."""
    skip = F.lit(skip) if isinstance(skip, int) else skip
    return sheet.filter(F.col("row_idx") >= skip).withColumn("row_idx", (F.col("row_idx") - skip).cast("int"))


def header_cells(sheet: DataFrame, drop: Column, fix=None) -> DataFrame:
    """Header row exploded to ``(file, pos, header)``: totals, blanks and repeats removed.

    ``fix`` maps a header column to its corrected text. Of a repeated header the first one stays.
    """
    header = F.col("header")
    cells = sheet.filter(F.col("row_idx") == 0).select(
        *[c for c in sheet.columns if c not in ("row_idx", "label", "cells")],
        F.posexplode("cells").alias("pos", "header"),
    )
    kept = cells.filter((F.trim(header) != "") & ~drop)
    if fix is not None:
        kept = kept.withColumn("header", fix(header))
    first = Window.partitionBy("file", "header").orderBy("pos")
    return kept.withColumn("copy", F.row_number().over(first)).filter("copy = 1").drop("copy")


def band_rows(sheet: DataFrame, env_end: Column, species_end: Column) -> DataFrame:
    """Tag each labelled data row with its band: ``environment``, ``species`` or ``footer``.

    A sheet without the row that ends its environment band fails, naming the file. The window is per sheet, which is one page; blank labels are dropped first, as in a hand-made
    sheet they are spacers.
    """
    rows = sheet.filter((F.col("row_idx") > 0) & (F.col("label") != ""))
    by_file = Window.partitionBy("file")
    env_row = F.min(F.when(F.col("label") == env_end, F.col("row_idx"))).over(by_file)
    marked = rows.withColumn("env_row", env_row)
    stop = F.min(F.when((F.col("label") == species_end) & (F.col("row_idx") > F.col("env_row")), F.col("row_idx")))
    marked = marked.withColumn("end_row", stop.over(by_file))
    band = (
        F.when(F.col("row_idx") <= F.col("env_row"), "environment")
        .when(F.col("end_row").isNull() | (F.col("row_idx") < F.col("end_row")), "species")
        .otherwise("footer")
    )
    lost = F.raise_error(F.concat(F.lit("no row that ends the environment band in "), F.col("file")))
    return marked.withColumn("band", F.when(F.col("env_row").isNotNull(), band).otherwise(lost)).drop("env_row", "end_row")


def unpivot_cells(rows: DataFrame, headers: DataFrame, value: str = "cell", keep: Sequence[str] = ()) -> DataFrame:
    """Wide to long: one row per (label, header) pair."""
    long = rows.select("file", "row_idx", "label", *keep, F.posexplode("cells").alias("pos", value))
    return long.join(headers.select("file", "pos", "header"), ["file", "pos"]).drop("pos")


def environment_table(
    long: DataFrame, names: dict[str, str], columns: Sequence[str], keys: Sequence[str] = ("file", "header")
) -> DataFrame:
    """Environment rows to one column per variable, one row per sheet and day.

    Where two labels feed one variable, the first cell of the sheet that is not blank counts.
    """
    from tallywing.functions.text import dotted_label
    from tallywing.operators.recode import lookup

    named = long.withColumn("variable", lookup(dotted_label(F.col("label")), names))
    filled = F.when(F.trim("cell") != "", F.col("row_idx"))
    return named.groupBy(*keys).pivot("variable", list(columns)).agg(F.coalesce(F.min_by("cell", filled), F.min("cell")))
