"""Count regressions with a log link: Poisson, negative binomial, zero-inflated negative binomial.

Each Newton step is one scan of the frame and one small aggregate. The frame is packed once into
blocks of at most a batch of rows of one group. In a step every block meets the current coefficients
of the models still running on its group and yields their partial sums: log-likelihood, gradient and
curvature. Spark adds the partial sums per (group, model) and a small matrix per model is solved. A
group that holds most of the rows is simply more blocks, spread over all tasks. All groups, families
and candidate models move together: a step for ten thousand models is the same single job.

The block sums are matrix products. Written as column expressions over the rows-by-models join, a
selection over 9,600 models took 215 s instead of 30 s, since the eighty sums of a row outgrow one
compiled method.

Negative binomial: variance mu + mu^2/theta. Zero inflation: one probability per group (intercept
only). Fixed effects only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.gamma import gamma_functions
from tallywing.session import settle, spread

FAMILIES = {"poisson": 0, "nbinom": 1, "nbinom+zi": 2}
FAMILY_NAMES = {code: name for name, code in FAMILIES.items()}

LOG_THETA_RANGE = (-8.0, 14.0)
ZETA_RANGE = (-15.0, 15.0)
TOLERANCE = 1e-8
MAX_STEPS = 60
MAX_HALVINGS = 25
LONGEST_STEP = 2.0
MOST_ETA = 50.0  # a step that takes a row's linear predictor beyond this is rejected
BLOCK_ROWS = 2_048
BLOCK_CELLS = 400_000  # rows x models worked on at a time, so that a block stays in cache

STATE = (
    "group string, model_id int, family int, mask int, params array<double>, base array<double>, step array<double>, "
    "base_loglik double, halvings int, steps int, done boolean, converged boolean, n bigint, loglik double, vcov array<double>"
)
_STATE_COLUMNS = [part.split()[0] for part in STATE.split(", ")]


def full_models(groups: DataFrame, families: Sequence[str], terms: int) -> DataFrame:
    """The model with every term, one per group and family; ``model_id`` is the family code."""
    codes = F.array(*[F.lit(FAMILIES[f]) for f in families])
    rows = groups.select("group", F.explode(codes).alias("family"))
    return rows.select(
        "group", F.col("family").alias("model_id"), "family", F.lit((1 << terms) - 1).alias("mask"),
        F.lit(None).cast("array<double>").alias("start"),
    )


def group_moments(design: DataFrame) -> DataFrame:
    return design.groupBy("group").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"),
        F.avg((F.col("y") == 0).cast("double")).alias("zeros"),
    )


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def start_state(models: DataFrame, moments: DataFrame, terms: int) -> DataFrame:
    """First guess: the group mean, theta from the variance, a part of the zeros as extra zeros.

    Groups without a single bird have no finite estimate: their models are done from the start, unconverged and without
    coefficients.
    """
    mean, var = F.col("mean"), F.coalesce("var", F.lit(0.0))
    theta = F.when(var > mean, mean * mean / F.greatest(var - mean, F.lit(1e-9))).otherwise(F.lit(50.0))
    extra = _clip(F.col("zeros") / 2, 0.02, 0.5)
    guess = F.concat(
        F.array(F.log("mean")), F.array_repeat(F.lit(0.0), terms),
        F.array(F.log(_clip(theta, 0.05, 50.0)), F.log(extra / (1 - extra))),
    )
    blank = F.array_repeat(F.lit(0.0), terms + 3)
    return models.join(moments, "group").select(
        "group", "model_id", "family", "mask", F.when(mean > 0, F.coalesce("start", guess)).alias("params"), blank.alias("base"),
        blank.alias("step"), F.lit(float("-inf")).alias("base_loglik"), F.lit(0).alias("halvings"), F.lit(0).alias("steps"),
        (mean <= 0).alias("done"), F.lit(False).alias("converged"), F.col("n"),
        F.lit(None).cast("double").alias("loglik"), F.lit(None).cast("array<double>").alias("vcov"),
    )


def sum_names(terms: int, negbin: bool, inflated: bool) -> list[str]:
    """Names of the sums a step needs: ``g`` gradient, ``h`` curvature, ``a`` log theta, ``z`` zero logit."""
    size = range(terms + 1)
    out = ["ll", *[f"g{j}" for j in size], *[f"h{j}_{k}" for j in size for k in range(j, terms + 1)]]
    if negbin:
        out += ["ga", "haa", *[f"ea{j}" for j in size]]
    if inflated:
        out += ["gz", "hzz", "haz", *[f"ez{j}" for j in size]]
    return out


def pack(design: DataFrame, terms: int) -> DataFrame:
    """Rows to blocks ``(group, rows, x, y)`` of at most ``BLOCK_ROWS`` rows.

    The sort is inside each partition, so packing moves no data.
    """
    columns = [f"x{i}" for i in range(1, terms + 1)]

    def blocks(batches):
        for pdf in batches:
            place = pdf.groupby("group", sort=False).cumcount() // BLOCK_ROWS
            parts = [(group, part) for (group, _), part in pdf.groupby(["group", place], sort=False)]
            yield pd.DataFrame({
                "group": [g for g, _ in parts], "rows": [len(part) for _, part in parts],
                "x": [part[columns].to_numpy().ravel() for _, part in parts], "y": [part["y"].to_numpy() for _, part in parts],
            })

    schema = "group string, rows int, x array<double>, y array<double>"
    return design.sortWithinPartitions("group").mapInPandas(blocks, schema)


def _derivatives(family: int, y: np.ndarray, eta: np.ndarray, params: np.ndarray, terms: int) -> dict[str, np.ndarray]:
    """Log-likelihood and derivatives for rows by models of one family.

    ``s``/``h`` are first and second derivatives in the linear predictor, ``sa``/``haa``/``ea`` those
    with log theta, ``sz``/``hzz``/``haz``/``ez`` those with the logit of the extra-zero probability.
    """
    mu, y1 = np.exp(eta), y[:, None]
    values, place = np.unique(y, return_inverse=True)
    log_factorial = gamma_functions(values + 1.0)[0][place][:, None]
    if family == 0:
        return {"l": y1 * eta - mu - log_factorial, "s": y1 - mu, "h": -mu}
    log_theta = params[:, terms + 1]
    theta = np.exp(log_theta)
    at_zero = gamma_functions(theta)
    lg, dg, tg = (f[place] - f0 for f, f0 in zip(gamma_functions(values[:, None] + theta), at_zero))
    tm = theta + mu
    lt, share = np.log(tm), (y1 + theta) / tm
    l = lg - log_factorial + theta * log_theta + y1 * eta - (y1 + theta) * lt
    s = theta * (y1 - mu) / tm
    h = -share * mu * theta / tm
    sa = theta * (dg + log_theta + 1 - lt - share)
    haa = theta * theta * (tg + 1 / theta - 2 / tm + share / tm) + sa
    ea = theta * (y1 - mu) * mu / (tm * tm)
    if family == 1:
        return {"l": l, "s": s, "h": h, "sa": sa, "haa": haa, "ea": ea}
    pi = 1 / (1 + np.exp(-params[:, terms + 2]))
    mass = pi + (1 - pi) * np.exp(l)
    none = y1 == 0
    q = np.where(none, pi / mass, 0.0)
    r = 1 - q
    return {
        "l": np.where(none, np.log(mass), np.log1p(-pi) + l), "s": r * s, "h": r * h + r * q * s * s,
        "sa": r * sa, "haa": r * haa + r * q * sa * sa, "ea": r * ea + r * q * s * sa,
        "sz": q - pi, "hzz": q * r - pi * (1 - pi), "haz": -q * r * sa, "ez": -q * r * s,
    }


def _block_sums(x: np.ndarray, y: np.ndarray, family: np.ndarray, params: np.ndarray, names: list[str]) -> np.ndarray:
    """Sums over the rows of one block for all its models: ``(models, names)``."""
    terms = x.shape[1]
    size = terms + 1
    left, right = np.triu_indices(size)
    where = {name: i for i, name in enumerate(names)}
    out = np.zeros((len(params), len(names)))
    for code in np.unique(family):
        mine = np.flatnonzero(family == code)
        sums = np.zeros((len(mine), len(names)))
        step = max(1, BLOCK_CELLS // len(mine))
        for begin in range(0, len(y), step):
            rows = np.column_stack([np.ones(len(y[begin:begin + step])), x[begin:begin + step]])
            eta = rows @ params[mine, :size].T
            near = (np.abs(eta) <= MOST_ETA).all(axis=0)
            d = _derivatives(int(code), y[begin:begin + step], np.clip(eta, -MOST_ETA, MOST_ETA), params[mine], terms)
            sums[:, where["ll"]] += np.where(near, d["l"].sum(axis=0), -np.inf)
            sums[:, where["g0"]:where["g0"] + size] += d["s"].T @ rows
            sums[:, where["h0_0"]:where["h0_0"] + len(left)] += d["h"].T @ (rows[:, left] * rows[:, right])
            if code >= 1:
                sums[:, where["ga"]] += d["sa"].sum(axis=0)
                sums[:, where["haa"]] += d["haa"].sum(axis=0)
                sums[:, where["ea0"]:where["ea0"] + size] += d["ea"].T @ rows
            if code == 2:
                for name, key in (("gz", "sz"), ("hzz", "hzz"), ("haz", "haz")):
                    sums[:, where[name]] += d[key].sum(axis=0)
                sums[:, where["ez0"]:where["ez0"] + size] += d["ez"].T @ rows
        out[mine] = sums
    return out


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Rows of an Arrow list column as numpy views."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]


PARTIAL = "group string, model_id int, sums array<double>"


def _partial_sums(terms: int, names: list[str]):
    """Blocks beside their models to one row of sums per block and model, Arrow in and Arrow out."""

    def partials(batches):
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            parts, models, groups = [], [], []
            for group, x, y, ids, family, params in zip(
                column["group"].to_pylist(), *(_lists(column[c]) for c in ("x", "y", "model_id", "family", "params"))
            ):
                parts.append(_block_sums(x.reshape(len(y), terms), y, family, params.reshape(len(ids), terms + 3), names))
                models.append(ids)
                groups += [group] * len(ids)
            if not parts:
                continue
            sums = np.concatenate(parts).ravel()
            ends = np.arange(0, len(sums) + 1, len(names), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.string()), pa.array(np.concatenate(models), pa.int32()), pa.ListArray.from_arrays(ends, sums)],
                names=["group", "model_id", "sums"],
            )

    return partials


def running_models(state: DataFrame) -> DataFrame:
    """One row per group with the coefficients of its running models side by side.

    The list is as long as the model space, never as long as the data.
    """
    models = F.sort_array(F.collect_list(F.struct("model_id", "family", "params")))
    listed = state.filter(~F.col("done")).groupBy("group").agg(models.alias("m"))
    return listed.select(
        "group", F.col("m.model_id").alias("model_id"), F.col("m.family").alias("family"), F.flatten("m.params").alias("params")
    )


def _advance(terms: int, negbin: bool, inflated: bool, covariance: bool):
    """One safeguarded Newton step for a batch of models, each from its own sums."""
    size, full = terms + 1, terms + 3

    where = {name: i for i, name in enumerate(sum_names(terms, negbin, inflated))}

    def assemble(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = np.zeros((len(sums), full)), np.zeros((len(sums), full, full))

        def put(a: int, b: int, name: str) -> None:
            hess[:, a, b] = hess[:, b, a] = sums[:, where[name]]

        for j in range(size):
            grad[:, j] = sums[:, where[f"g{j}"]]
            for k in range(j, size):
                put(j, k, f"h{j}_{k}")
            if negbin:
                put(j, size, f"ea{j}")
            if inflated:
                put(j, size + 1, f"ez{j}")
        if negbin:
            grad[:, size] = sums[:, where["ga"]]
            put(size, size, "haa")
        if inflated:
            grad[:, size + 1] = sums[:, where["gz"]]
            put(size + 1, size + 1, "hzz")
            put(size, size + 1, "haz")
        return grad, hess

    def free_parameters(pdf: pd.DataFrame, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        family, mask = pdf["family"].to_numpy(), pdf["mask"].to_numpy()
        free = np.ones((len(pdf), full), dtype=bool)
        for j in range(1, size):
            free[:, j] = (mask >> (j - 1)) & 1 == 1
        for at, needed, (low, high) in ((size, 1, LOG_THETA_RANGE), (size + 1, 2, ZETA_RANGE)):
            pinned = ((params[:, at] <= low) & (grad[:, at] < 0)) | ((params[:, at] >= high) & (grad[:, at] > 0))
            free[:, at] = (family >= needed) & ~pinned
        return free

    def runaway(params: np.ndarray, grad: np.ndarray, newton: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Steps straight to the bound for a parameter whose best value is infinite.

        There the likelihood flattens like an exponential and Newton creeps by about 1 a step. A jump
        that lowers the likelihood is halved like any other step.
        """
        jump = np.zeros_like(newton)
        for at, sign, far, bound in ((size, 1.0, 5.0, LOG_THETA_RANGE[1]), (size + 1, -1.0, 4.0, ZETA_RANGE[0])):
            creeping = (sign * params[:, at] > far) & (sign * grad[:, at] > 0) & (np.abs(sign * newton[:, at] - 1) < 0.5)
            jump[:, at] = np.where(creeping & free[:, at], bound - params[:, at], 0.0)
        return jump

    def step_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        params, base, step = (np.stack(pdf[c].to_numpy()) for c in ("params", "base", "step"))
        sums = np.stack(pdf["sums"].to_numpy())
        loglik, base_loglik = sums[:, where["ll"]], pdf["base_loglik"].to_numpy()
        grad, hess = assemble(sums)
        free = free_parameters(pdf, params, grad)
        accepted = np.isfinite(loglik) & (loglik >= base_loglik - 1e-9 * (1 + np.abs(base_loglik)))
        accepted |= np.isneginf(base_loglik) & np.isfinite(loglik)

        both = free[:, :, None] & free[:, None, :]
        curve = np.where(both, -hess, 0.0)
        at = np.arange(full)
        curve[:, at, at] = np.where(free, curve[:, at, at], 1.0)
        curve = np.where(np.isfinite(curve), curve, np.eye(full))
        slope = np.where(free & np.isfinite(grad), grad, 0.0)
        values, vectors = np.linalg.eigh(curve)
        sizes = np.maximum(np.abs(values), 1e-10 * np.abs(values).max(axis=1, keepdims=True))
        newton = np.einsum("mij,mj->mi", vectors, np.einsum("mji,mj->mi", vectors, slope) / sizes)
        gain = np.einsum("mi,mi->m", slope, newton)
        away = runaway(params, grad, newton, free)
        newton /= np.maximum(1.0, np.abs(newton).max(axis=1) / LONGEST_STEP)[:, None]
        newton = np.where(away != 0, away, newton)

        done = accepted & (gain < TOLERANCE)
        halvings = np.where(accepted, 0, pdf["halvings"].to_numpy() + 1)
        stalled = ~accepted & (halvings > MAX_HALVINGS)
        out = pdf[_STATE_COLUMNS].copy()
        next_step = np.where(accepted[:, None], newton, step / 2)
        next_base = np.where(accepted[:, None], params, base)
        target = next_base + np.where(stalled[:, None], 0.0, next_step)
        target[:, size] = np.clip(target[:, size], *LOG_THETA_RANGE)
        target[:, size + 1] = np.clip(target[:, size + 1], *ZETA_RANGE)
        out["params"], out["base"], out["step"] = list(target), list(next_base), list(next_step)
        out["base_loglik"] = np.where(accepted, loglik, base_loglik)
        out["halvings"], out["steps"] = halvings, pdf["steps"].to_numpy() + 1
        out["done"] = done | stalled | (out["steps"].to_numpy() >= MAX_STEPS)
        out["converged"] = done
        out["loglik"] = np.where(done, loglik + gain / 2, out["base_loglik"])
        if covariance:
            inverse = np.einsum("mij,mj,mkj->mik", vectors, 1 / sizes, vectors)
            inverse = np.where(both, inverse, 0.0)[:, :size, :size].reshape(len(pdf), -1)
            out["vcov"] = list(inverse)
        return out

    def advance(batches):
        for pdf in batches:
            waiting = pdf["done"].to_numpy(dtype=bool)
            parts = [pdf.loc[waiting, _STATE_COLUMNS]]
            if (~waiting).any():
                parts.append(step_batch(pdf.loc[~waiting].reset_index(drop=True)))
            yield pd.concat([p for p in parts if len(p)], ignore_index=True)

    return advance


class CountFrame(NamedTuple):
    """A design made ready for any number of fits."""

    blocks: DataFrame
    moments: DataFrame
    terms: int


def prepare(design: DataFrame, terms: int) -> CountFrame:
    """Settle a design ``(group, y, x1 .. xp)`` as blocks, with the moments the first guess needs."""
    table = settle(design.select("group", "y", *[f"x{i}" for i in range(1, terms + 1)]), "design")
    blocks = settle(pack(spread(table), terms), "blocks")
    return CountFrame(blocks, settle(group_moments(table), "moments"), terms)


def fit_counts(frame: CountFrame, models: DataFrame, families: Sequence[str], covariance: bool = True) -> DataFrame:
    """Fit every row of ``models`` (``group, model_id, family, mask, start``) on a prepared frame.

    ``mask`` says which terms a model has (bit i is term i). Returns one row per model:
    ``group, model_id, family, mask, n, k, loglik, converged, steps, beta, log_theta, zeta, vcov``. A model that did not converge
    stays, with ``converged`` false; a group without a single bird has no coefficients.
    The loop runs on the driver, but it only asks one yes/no question per step; state stays in a
    table in the shared folder, which also cuts the lineage.
    """
    negbin, inflated = any(f != "poisson" for f in families), "nbinom+zi" in families
    blocks, moments, terms = frame
    state = settle(start_state(models, moments, terms), "fit")
    names = sum_names(terms, negbin, inflated)
    partials, advance = _partial_sums(terms, names), _advance(terms, negbin, inflated, covariance)
    sums = F.array(*[F.sum(F.get("sums", i)) for i in range(len(names))]).alias("sums")
    for _ in range(MAX_STEPS):
        met = blocks.join(running_models(state), "group")
        summed = met.mapInArrow(partials, PARTIAL).groupBy("group", "model_id").agg(sums)
        state = settle(state.join(summed, ["group", "model_id"], "left").mapInPandas(advance, STATE), "fit")
        if state.filter(~F.col("done")).isEmpty():
            break
    return fitted(state, terms)


def fitted(state: DataFrame, terms: int) -> DataFrame:
    family = F.col("family")
    return state.select(
        "group", "model_id", F.element_at(F.array(*[F.lit(FAMILY_NAMES[i]) for i in range(3)]), family + 1).alias("family"),
        "mask", "n", (1 + F.bit_count("mask") + family).cast("int").alias("k"), "loglik", "converged", "steps",
        F.slice("params", 1, terms + 1).alias("beta"),
        F.when(family >= 1, F.get("params", terms + 1)).alias("log_theta"),
        F.when(family == 2, F.get("params", terms + 2)).alias("zeta"), "vcov",
    )


def fit_full(frame: DataFrame, families: Sequence[str], by: str = "species", terms: Sequence[str] | None = None) -> DataFrame:
    """Full model of each family for every group of a model frame."""
    from tallywing.operators.scaling import TERMS, design

    terms = list(terms or TERMS)
    # The frame is read twice, for its scale and for the design: settle it first.
    ready = prepare(design(settle(frame, "frame"), by, terms), len(terms))
    return fit_counts(ready, full_models(ready.moments, families, len(terms)), families)


def coefficients(fits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Long table ``(group, model_id, family, term, estimate, se, z)``; terms a model lacks are left out."""
    names = ["intercept", *terms]
    size = len(names)
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("term"), F.get("beta", i).alias("estimate"),
            F.sqrt(F.greatest(F.get("vcov", i * size + i), F.lit(0.0))).alias("se"),
            (F.lit(i == 0) | (F.shiftright("mask", max(i - 1, 0)).bitwiseAND(1) == 1)).alias("has"),
        ) for i, name in enumerate(names)
    ])
    rows = fits.filter("beta is not null").select("group", "model_id", "family", F.explode(cells).alias("c")).filter("c.has")
    flat = rows.select("group", "model_id", "family", "c.term", "c.estimate", "c.se")
    return flat.withColumn("z", F.try_divide("estimate", "se"))


def coefficient_table(fits: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The same with the two-sided normal p-value."""
    from tallywing.functions.special import normal_two_sided_p

    return coefficients(fits, terms).withColumn("p_value", normal_two_sided_p(F.col("z")))
