"""Lookup files, hand-edited columns, and panel sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.functions.dates import parse_us_date


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV with a header; the text ``NA`` is NULL."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def read_hand_edits(spark: SparkSession, path: str) -> DataFrame:
    """Start times, wind and visibility scores typed after the season, one row per day."""
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    return raw.select(
        parse_us_date(F.col("date")).alias("date"),
        *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in
          ("start.time", "start.time.2", "wind.direction", "visibility.score") if c in raw.columns],
    )


def union_hand_edits(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Older edits are repeated on every species row, so they are made distinct first."""
    return older.distinct().unionByName(newer, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "NA").csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet partitioned by year, so that season filters prune whole folders.

    Rows are rebalanced by year first: a year is in few files, and a large one is split.
    """
    df.hint("rebalance", "year").write.partitionBy("year").parquet(path)


def replace_seasons(df: DataFrame, path: str) -> None:
    """Write the seasons of ``df`` to a panel table; those it holds are replaced, all others stay as they are.

    The writer stages the new files and swaps the folders of those years when all tasks are done, so a run that fails or
    is repeated leaves each season whole, and never twice. ``df`` must not read from ``path``.
    """
    writer = df.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year").parquet(path)
