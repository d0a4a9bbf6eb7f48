"""Helpers shared by the training-text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import session

#: Fixed: a word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark deletes the shuffle files of a query when it ends, where this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """``session.settle``; the shuffle files of the step are deleted once it is written, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return session.settle(df, label)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; NULL counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that none of ``taken`` clashes with, whatever its case."""
    used = {name.lower() for name in taken}
    found = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) per labelled document.

    Rows whose id is NULL or whose label is neither 0 nor 1 are left out, and so are documents that
    carry both labels; repeated rows count once.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")


#: Seconds without a partition after which a worker drops what it keeps.
IDLE = 2.0


def _kept() -> dict:
    return sys.modules.setdefault("tallywing_worker", types.ModuleType("tallywing_worker")).__dict__


def worker_keeps(key: tuple, make: Callable):
    """``make()``, once for each worker process: functions travel to workers by value, so a module's own table would not outlive a task.

    A worker that ``frugal`` finds idle drops its tables and makes them anew when they are asked for.
    """
    tables = _kept().setdefault("tables", {})
    if key not in tables:
        tables[key] = make()
    return tables[key]


def trim() -> None:
    """Give the memory that is no longer needed back to the machine."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if malloc_trim is not None:
        malloc_trim(0)


def frugal(read: Callable) -> Callable:
    """``read`` for mapInArrow, giving memory back to the machine when its partition is done.

    Workers stay for later stages, and what they hold on to counts against the executor there: allocators' free memory
    goes back at once, kept tables when the next partition does not follow soon.
    """

    def drop():
        _kept().pop("tables", None)
        trim()

    def run(batches):
        waiting = _kept().pop("waiting", None)
        if waiting is not None:
            waiting.cancel()
        yield from read(batches)
        trim()
        if _kept().get("tables"):
            import threading

            waiting = _kept()["waiting"] = threading.Timer(IDLE, drop)
            waiting.daemon = True
            waiting.start()

    return run


__all__ = ["WORD", "table", "word_count", "free_names", "labels_of", "settle", "worker_keeps", "frugal"]
