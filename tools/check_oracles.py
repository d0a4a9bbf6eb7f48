"""Run every query and its SQL side by side and compare columns, types and values exactly.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql.types import IntegralType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallywing.plans.catalog import load  # noqa: E402
from tallywing.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cells = df.astype(object).where(df.notna(), None)
    def text(v):
        if v is None:
            return ""
        if hasattr(v, "isoformat"):
            return v.isoformat().replace("T00:00:00", "")
        if hasattr(v, "tolist"):
            return str(v.tolist())
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)
    return sorted(tuple(text(v) for v in row) for row in cells.itertuples(index=False))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype) for c in sorted(df.columns)}


def compare(query, spark, con, folder) -> tuple[str, float, int]:
    start = time.time()
    found = query(spark, folder)
    got = found.toPandas()
    took = time.time() - start
    for field in found.schema:  # pandas shows whole numbers with NULLs among them as floats
        if isinstance(field.dataType, IntegralType) and got[field.name].dtype.kind == "f":
            got[field.name] = got[field.name].astype("Int32" if field.dataType.simpleString() == "int" else "Int64")
    if query.sql is None:
        return "rows-only", took, len(got)
    want = con.execute(query.sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", took, len(got)
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}", took, len(got)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"VALUES {len(bad)} differ, first {bad[0]} types {kinds(got)} {kinds(want)}", took, len(got)
    if kinds(got) != kinds(want):
        return f"ok (types {kinds(got)} vs {kinds(want)})", took, len(got)
    return "ok", took, len(got)


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    for name, query in load().items():
        if names and name not in names:
            continue
        try:
            verdict, took, rows = compare(query, spark, con, folder)
        except Exception as error:  # noqa: BLE001
            verdict, took, rows = f"ERROR {str(error)[:1500]}", 0.0, 0
        good = verdict == "ok" or verdict.startswith("rows-only")
        bad += not good
        print(f"{name:28s} {took:6.2f}s {rows:7d} {verdict}", flush=True)
    print("not matching:", bad)


if __name__ == "__main__":
    main()
