"""Linear models on log(rate + 1): tall-skinny QR, one pass and one small solve per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the first, the base; NULL where the value is none of the levels, so that such a
    row leaves the fit and does not join the base."""
    names = [f"{column}={level}" for level in levels[1:]]
    known = F.col(column).isin(*levels)
    return df.withColumns({name: F.when(known, (F.col(column) == level).cast("double")) for name, level in zip(names, levels[1:])}), names


#: A column whose part outside the columns before it is smaller than this share of it is taken as depending on them.
ALIASED = 1e-9
#: Triangles of a group that one task merges on the first level.
MERGED = 64


def _triangle(stack: np.ndarray) -> np.ndarray:
    """Upper triangle R of the QR decomposition, with a row per column whatever the number of rows."""
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))])


def triangles(table: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(by, n, r): the triangle of each group's tall matrix of ``columns``, from those of its parts, merged in a tree.

    No cross product is formed, so nothing is squared; a part holds one triangle a group, however many rows it has.
    """
    size = len(columns)
    schema = f"{by} string, n long, r array<double>"

    def parts(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for group, mine in pdf.groupby(by, sort=False):
                n, r = held.get(group, (0, np.zeros((0, size))))
                held[group] = n + len(mine), _triangle(np.vstack([r, mine[list(columns)].to_numpy(float)]))
        yield pd.DataFrame([(g, n, r.ravel()) for g, (n, r) in held.items()], columns=[by, "n", "r"])

    def merge(_, pdf):
        stack = np.vstack([np.asarray(r, float).reshape(-1, size) for r in pdf["r"]])
        return pd.DataFrame([(pdf[by].iloc[0], int(pdf["n"].sum()), _triangle(stack).ravel())], columns=[by, "n", "r"])

    first = table.select(F.col(by).cast("string").alias(by), *columns).mapInPandas(parts, schema)
    near = first.withColumn("part", F.floor(F.spark_partition_id() / MERGED)).groupBy(by, "part").applyInPandas(merge, schema)
    return near.groupBy(by).applyInPandas(merge, schema)


def _independent(r: np.ndarray) -> list[int]:
    """Columns, from the left, that do not depend on those before them."""
    kept: list[int] = []
    for j in range(r.shape[1]):
        outside = abs(np.linalg.qr(r[:, [*kept, j]], mode="r")[len(kept), len(kept)])
        if outside > ALIASED * np.linalg.norm(r[:, j]):
            kept.append(j)
    return kept


def ols(df: DataFrame, y: str, x: Sequence[str], by: str = "group") -> DataFrame:
    """Least squares of ``y`` on an intercept and ``x`` per group: estimate and standard error per term.

    A term that depends on those before it has neither (NULL), and the others are those of the model without it. Rows with
    a NULL have no part.
    """
    x = list(x)
    safe = {name: f"v{i}" for i, name in enumerate(["intercept", *x, y])}
    table = df.select(by, F.lit(1.0).alias("v0"), *[F.col(f"`{n}`").cast("double").alias(safe[n]) for n in [*x, y]]).dropna("any")
    columns = list(safe.values())
    size = len(columns) - 1

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                r = np.asarray(row["r"], float).reshape(size + 1, size + 1)
                kept = _independent(r[:, :size])
                small = np.linalg.qr(r[:, [*kept, size]], mode="r")
                rank = len(kept)
                inverse = np.linalg.inv(small[:rank, :rank])
                beta, free = inverse @ small[:rank, rank], row["n"] - rank
                rest = small[rank, rank] ** 2 if len(small) > rank else 0.0
                se = np.sqrt(rest / free) * np.linalg.norm(inverse, axis=1) if free > 0 else np.full(rank, np.nan)
                found = dict(zip(kept, zip(beta, se)))
                for i, term in enumerate(["intercept", *x]):
                    estimate, error = found.get(i, (None, None))
                    out.append((row[by], term, estimate, error))
            yield pd.DataFrame(out, columns=[by, "term", "estimate", "se"])

    return triangles(table, columns, by).mapInPandas(solve, f"{by} string, term string, estimate double, se double")


def levels_of(df: DataFrame, column: str, most: int = 1_000) -> list:
    """The levels of a category, sorted; a category with more than ``most`` is refused."""
    found = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return found


def log_rate_model(daily: DataFrame, categories: dict[str, Sequence[str] | None], base_year: float, by: str = "group") -> DataFrame:
    """log(birds per hour + 1) on centred year and categorical columns, each with its levels or, where they are None, those found."""
    table = daily.withColumns({
        "log_rate": F.log1p("birds_per_hour"), "year": F.col("year") - F.lit(float(base_year)),
    })
    names = ["year"]
    for column, levels in categories.items():
        table, hot = one_hot(table, column, levels_of(daily, column) if levels is None else list(levels))
        names += hot
    return ols(table, "log_rate", names, by)
