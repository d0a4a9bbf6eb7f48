"""Registry of checked queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.plans.standins import Tables, with_views

MODULES = ("sheet_queries", "clean_queries", "summary_queries", "weather_queries", "model_queries", "score_queries", "mixed_queries", "timing_queries")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), dates: tuple[str, ...] = ()):
    """Register ``build(tables)`` under ``name``.

    ``views`` are the stand-ins its SQL reads; ``dates`` are result columns shown as text on both
    sides, since the two engines hand dates and times to Python as different types.
    """

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else with_views(sql, *views)
        shown = build
        if dates:
            def shown(tables: Tables) -> DataFrame:
                return build(tables).withColumns({d: F.col(d).cast("string") for d in dates})

            if text is not None:
                casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
                text = f"SELECT * REPLACE ({casts}) FROM ({text}) AS result"
        CATALOG[name] = Query(name, shown, text)
        return build

    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tallywing.plans.{module}")
    return CATALOG
