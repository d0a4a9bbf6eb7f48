"""Count regressions with random effects: observer levels, species lines, autocorrelated years.

The marginal likelihood is Laplace's: the effects at their mode and the curvature there, as in the published models. One
step is one scan. The frame is packed into blocks whose rows are sorted by cell, a cell being one combination of levels; a
block meets the coefficients and effects of the models still running and yields one row of sums for each of its cells and
models. In a cell an effect acts through the intercept or through one term, so the sums of the fixed part (gradient,
curvature, and the third derivatives that the curvature's own slope needs) serve the effects as well: no row is ever looked
up by level. Spark adds the sums per model and cell. Then each model's effects are eliminated from its equations by a Schur
complement, and coefficients, dispersion, variances and effects move together: the gradient is that of the Laplace
likelihood, exactly, the curvature that of the likelihood given the variances, and expected information for the variances.
A step that does not raise the likelihood is halved.

A group's effects are as many as its levels (observers, years; twice the species for lines), which field panels have in
hundreds at most; ``MOST_EFFECTS`` is checked, since a model's equations are solved by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.operators import count_models as cm
from tallywing.operators.count_models import BLOCK_ROWS, FAMILIES, FAMILY_NAMES, LOG_THETA_RANGE, MAX_HALVINGS, ZETA_RANGE
from tallywing.operators.scaling import TERMS, design
from tallywing.session import settle, spread

MAX_STEPS, TOLERANCE, LONGEST_STEP = 100, 1e-8, 2.0
LOG_SD_RANGE, ATANH_RANGE = (-8.0, 4.0), (-5.0, 5.0)
FIRST_LOG_SD = -1.0
#: Twice the height by which the effects may be off their mode, an effect, when a point is judged; above ``NEAR`` a judgement may be revised.
FAR, NEAR, MOST_INNER = 0.02, 1e-12, 12
#: Below this a correlation has nothing to correlate and stays where it is.
LEAST_LOG_SD = -4.0
MOST_EFFECTS = 2_000
#: Bits of a cell's code that each grouping has.
LEVEL_BITS = 20


class Random(NamedTuple):
    """A random term: one effect per level of ``column`` ("level"), a line per level, with a covariance of its own, in the
    model term ``slope`` ("line"), or one effect per year, correlated from year to year ("ar1", years without rows included)."""

    column: str
    kind: str = "level"
    slope: str | None = None

    @property
    def width(self) -> int:
        return 2 if self.kind == "line" else 1

    @property
    def names(self) -> list[str]:
        return {"level": ["log_sd"], "line": ["log_sd", "log_sd_slope", "atanh_r"], "ar1": ["log_sd", "atanh_r"]}[self.kind]


OBSERVER = Random("observer")
YEARS = Random("year", "ar1")
SPECIES_LINES = Random("species", "line", "year")


def precision(random: Random, levels: int, kappa: np.ndarray) -> tuple[np.ndarray, complex]:
    """Precision matrix of a term's effects and its log determinant; ``kappa`` may be complex, for derivatives."""
    sd = np.exp(kappa[0])
    if random.kind == "level":
        return np.eye(levels) / sd**2, -2 * levels * kappa[0]
    r = np.tanh(kappa[-1])
    if random.kind == "ar1":
        ends = np.ones(levels, kappa.dtype)
        ends[1:-1] += r * r
        next_ = np.eye(levels, k=1) + np.eye(levels, k=-1)
        free = 1 - r * r if levels > 1 else 1.0
        return (np.diag(ends) - r * next_) / (sd**2 * free), -2 * levels * kappa[0] - (levels - 1) * np.log(1 - r * r)
    sd1, free = np.exp(kappa[1]), 1 - r * r
    one = np.array([[1 / sd**2, -r / (sd * sd1)], [-r / (sd * sd1), 1 / sd1**2]]) / free
    return np.kron(np.eye(levels), one), -levels * (2 * kappa[0] + 2 * kappa[1] + np.log(free))


def all_precisions(randoms: Sequence[Random], sizes: Sequence[int], kappa: np.ndarray) -> tuple[np.ndarray, float, list[np.ndarray], np.ndarray]:
    """Precision of all effects, its log determinant, and the derivatives of both in every variance parameter."""
    widths = [len(r.names) for r in randoms]
    total = sum(r.width * n for r, n in zip(randoms, sizes))
    whole, logdet, slopes, slopes_logdet = np.zeros((total, total)), 0.0, [], []
    at, first = 0, 0
    for random, n, width in zip(randoms, sizes, widths):
        mine, place = kappa[at: at + width], slice(first, first + random.width * n)
        value, log = precision(random, n, mine.astype(complex))
        whole[place, place], logdet = value.real, logdet + log.real
        for j in range(width):
            moved = mine.astype(complex)
            moved[j] += 1e-30j
            value, log = precision(random, n, moved)
            slope = np.zeros((total, total))
            slope[place, place] = value.imag / 1e-30
            slopes.append(slope)
            slopes_logdet.append(log.imag / 1e-30)
        at, first = at + width, first + random.width * n
    return whole, logdet, slopes, np.array(slopes_logdet)


class Layout(NamedTuple):
    """Where things stand: terms of the model, its random terms, the term of a line (0: none), and powers of it that sums carry."""

    terms: int
    randoms: tuple[Random, ...]
    slope: int
    negbin: bool
    inflated: bool

    @property
    def powers(self) -> int:
        return 3 if self.slope else 1

    @property
    def parts(self) -> list[int]:
        """For each effect that a row has, the column it acts through: 0, or that of the line's term."""
        return [c for r in self.randoms for c in ((0, self.slope) if r.kind == "line" else (0,))]

    def names(self) -> list[str]:
        out = cm.sum_names(self.terms, self.negbin, self.inflated)
        out += [f"t{k}_{j}" for k in range(self.powers) for j in range(self.terms + 1)]
        if self.negbin:
            out += [f"ta{k}" for k in range(self.powers)]
        if self.inflated:
            out += [f"tz{k}" for k in range(self.powers)]
        return out


def third(family: int, y: np.ndarray, eta: np.ndarray, params: np.ndarray, terms: int) -> dict[str, np.ndarray]:
    """Derivatives of the curvature ``h``: ``t`` in the linear predictor, ``ha`` in log theta, ``hz`` in the logit of extra zeros."""
    mu, y1 = np.exp(eta), y[:, None]
    if family == 0:
        return {"t": -mu}
    theta = np.exp(params[:, terms + 1])
    cube = (theta + mu) ** 3
    t = -(y1 + theta) * theta * mu * (theta - mu) / cube
    ha = theta * mu * (y1 * theta - y1 * mu - 2 * theta * mu) / cube
    if family == 1:
        return {"t": t, "ha": ha}
    plain = cm._derivatives(1, y, eta, params, terms)
    pi = 1 / (1 + np.exp(-params[:, terms + 2]))
    q = np.where(y1 == 0, pi / (pi + (1 - pi) * np.exp(plain["l"])), 0.0)
    r = 1 - q
    s, h, sa, ea = plain["s"], plain["h"], plain["sa"], plain["ea"]
    return {
        "t": r * t + 3 * r * q * s * h + r * q * (q - r) * s**3,
        "ha": r * ha + r * q * (sa * h + 2 * s * ea) + r * q * (q - r) * sa * s * s,
        "hz": -r * q * (h + (q - r) * s * s),
    }


def cell_sums(layout: Layout, rows: np.ndarray, y: np.ndarray, eta: np.ndarray, family: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Sums over the rows of one cell for all its models: ``(models, names)``."""
    terms, size, names = layout.terms, layout.terms + 1, layout.names()
    where = {name: i for i, name in enumerate(names)}
    left, right = np.triu_indices(size)
    powers = [rows * rows[:, [layout.slope]] ** k for k in range(layout.powers)] if layout.slope else [rows]
    ones = [p[:, 0] for p in powers]
    out = np.zeros((len(params), len(names)))
    for code in np.unique(family):
        mine = np.flatnonzero(family == code)
        e, p = np.clip(eta[:, mine], -cm.MOST_ETA, cm.MOST_ETA), params[mine]
        d, d3 = cm._derivatives(int(code), y, e, p, terms), third(int(code), y, e, p, terms)
        sums = np.zeros((len(mine), len(names)))
        sums[:, where["ll"]] = np.where((np.abs(eta[:, mine]) <= cm.MOST_ETA).all(axis=0), d["l"].sum(axis=0), -np.inf)
        sums[:, where["g0"]: where["g0"] + size] = d["s"].T @ rows
        sums[:, where["h0_0"]: where["h0_0"] + len(left)] = d["h"].T @ (rows[:, left] * rows[:, right])
        for k, power in enumerate(powers):
            sums[:, where[f"t{k}_0"]: where[f"t{k}_0"] + size] = d3["t"].T @ power
        if code >= 1:
            for name, key in (("ga", "sa"), ("haa", "haa")):
                sums[:, where[name]] = d[key].sum(axis=0)
            sums[:, where["ea0"]: where["ea0"] + size] = d["ea"].T @ rows
            for k, one in enumerate(ones):
                sums[:, where[f"ta{k}"]] = d3["ha"].T @ one
        if code == 2:
            for name, key in (("gz", "sz"), ("hzz", "hzz"), ("haz", "haz")):
                sums[:, where[name]] = d[key].sum(axis=0)
            sums[:, where["ez0"]: where["ez0"] + size] = d["ez"].T @ rows
            for k, one in enumerate(ones):
                sums[:, where[f"tz{k}"]] = d3["hz"].T @ one
        out[mine] = sums
    return out


PARTIAL = "group string, model_id int, cell bigint, sums array<double>"


def first_effects(layout: Layout, sizes: Sequence[int]) -> list[int]:
    """Place of each random term's first effect."""
    return np.cumsum([0] + [r.width * n for r, n in zip(layout.randoms, sizes)])[:-1].tolist()


def effect_places(layout: Layout, sizes: Sequence[int], codes: np.ndarray) -> np.ndarray:
    """Places of the effects that each row of ``codes`` (one level a random term) has, in the order of ``layout.parts``."""
    columns = []
    for k, (random, first) in enumerate(zip(layout.randoms, first_effects(layout, sizes))):
        columns += [first + random.width * codes[:, k] + j for j in range(random.width)]
    return np.column_stack(columns)


def partial_sums(layout: Layout):
    """Blocks beside their models to one row of sums per cell and model."""
    terms, ties = layout.terms, len(layout.randoms)

    def partials(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y = np.asarray(row.y, float)
                rows = np.column_stack([np.ones(len(y)), np.asarray(row.x, float).reshape(len(y), terms)])
                codes = np.asarray(row.codes, np.int64).reshape(len(y), ties)
                ids, family = np.asarray(row.model_id), np.asarray(row.family)
                params = np.asarray(row.params, float).reshape(len(ids), terms + 3)
                effects = np.asarray(row.effects, float).reshape(len(ids), -1)
                cell = sum(codes[:, k] << LEVEL_BITS * k for k in range(ties))
                begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                places = effect_places(layout, row.sizes, codes[begin])
                for k, (a, b) in enumerate(zip(begin, [*begin[1:], len(y)])):
                    part = rows[a:b]
                    eta = part @ params[:, : terms + 1].T + part[:, layout.parts] @ effects[:, places[k]].T
                    sums = cell_sums(layout, part, y[a:b], eta, family, params)
                    out += [(row.group, int(i), int(cell[a]), s) for i, s in zip(ids, sums)]
            yield pd.DataFrame(out, columns=["group", "model_id", "cell", "sums"])

    return partials


STATE = (
    "group string, model_id int, family int, mask int, point array<double>, base array<double>, step array<double>, "
    "base_value double, base_gap double, halvings int, inner int, steps int, done boolean, converged boolean, n bigint, sizes array<int>, loglik double, vcov array<double>"
)
_STATE_COLUMNS = [part.split()[0] for part in STATE.split(", ")]


class Sums:
    """One model's sums over its cells, put together."""

    def __init__(self, layout: Layout, sizes: Sequence[int], cells: np.ndarray, sums: np.ndarray):
        where = {name: i for i, name in enumerate(layout.names())}
        size, full = layout.terms + 1, layout.terms + 3
        codes = np.column_stack([cells >> LEVEL_BITS * k & (1 << LEVEL_BITS) - 1 for k in range(len(layout.randoms))])
        idx, parts = effect_places(layout, sizes, codes), layout.parts
        q = sum(r.width * n for r, n in zip(layout.randoms, sizes))
        g = sums[:, where["g0"]: where["g0"] + size]
        left, right = np.triu_indices(size)
        h = np.zeros((len(cells), size, full))
        h[:, left, right] = h[:, right, left] = sums[:, where["h0_0"]: where["h0_0"] + len(left)]
        self.loglik = sums[:, where["ll"]].sum()
        self.gradient, self.curvature = np.zeros(full), np.zeros((full, full))
        self.gradient[:size] = g.sum(axis=0)
        if layout.negbin:
            h[:, :, size] = sums[:, where["ea0"]: where["ea0"] + size]
            self.gradient[size] = sums[:, where["ga"]].sum()
            self.curvature[size, size] = sums[:, where["haa"]].sum()
        if layout.inflated:
            h[:, :, size + 1] = sums[:, where["ez0"]: where["ez0"] + size]
            self.gradient[size + 1] = sums[:, where["gz"]].sum()
            self.curvature[size + 1, size + 1] = sums[:, where["hzz"]].sum()
            self.curvature[size, size + 1] = self.curvature[size + 1, size] = sums[:, where["haz"]].sum()
        self.curvature[:size] += h.sum(axis=0)
        self.curvature[size:, :size] = self.curvature[:size, size:].T
        self.effects, self.cross, self.weight = np.zeros(q), np.zeros((q, full)), np.zeros((q, q))
        np.add.at(self.effects, idx, g[:, parts])
        np.add.at(self.cross, idx, h[:, parts, :])
        np.add.at(self.weight, (idx[:, :, None], idx[:, None, :]), -h[:, parts][:, :, parts])
        self.idx, self.parts, self.layout = idx, parts, layout
        self.t = np.stack([sums[:, where[f"t{k}_0"]: where[f"t{k}_0"] + size] for k in range(layout.powers)])
        self.ta = np.stack([sums[:, where[f"ta{k}"]] for k in range(layout.powers)]) if layout.negbin else None
        self.tz = np.stack([sums[:, where[f"tz{k}"]] for k in range(layout.powers)]) if layout.inflated else None

    def slopes(self, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minus the derivatives of log det D, D being the effects' curvature with inverse ``inverse``: in the parameters, and in the effects.

        They are sums of third derivatives times z' inverse z, z being what a row has of the effects: a square of the line's term.
        """
        size, full = self.layout.terms + 1, self.layout.terms + 3
        mine = inverse[self.idx[:, :, None], self.idx[:, None, :]]
        power = np.array([[bool(a) + bool(b) for b in self.parts] for a in self.parts])
        weight = np.stack([mine[:, power == k].sum(axis=1) for k in range(self.layout.powers)])
        of_terms = np.einsum("kc,kcj->cj", weight, self.t)
        out = np.zeros(full)
        out[:size] = of_terms.sum(axis=0)
        if self.ta is not None:
            out[size] = (weight * self.ta).sum()
        if self.tz is not None:
            out[size + 1] = (weight * self.tz).sum()
        effects = np.zeros(len(self.effects))
        np.add.at(effects, self.idx, of_terms[:, self.parts])
        return out, effects


def solved(curve: np.ndarray, slope: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton step over the free parameters, and the inverse of the curvature; a direction of wrong curvature keeps its size."""
    both = np.outer(free, free)
    curve = np.where(both, curve, 0.0)
    curve[~free, ~free] = 1.0
    values, vectors = np.linalg.eigh((curve + curve.T) / 2)
    sizes = np.maximum(np.abs(values), 1e-10 * np.abs(values).max())
    inverse = np.where(both, (vectors / sizes) @ vectors.T, 0.0)
    return inverse @ np.where(free, slope, 0.0), inverse


def laplace(sums: Sums, randoms: Sequence[Random], sizes: Sequence[int], kappa: np.ndarray, effects: np.ndarray):
    """Laplace likelihood at a point, its gradient in parameters and variances, and what a step needs.

    The effects need not be at their mode: value and gradient are carried there by one Newton step of the effects.
    """
    prior, prior_log, slopes, slopes_log = all_precisions(randoms, sizes, kappa)
    curve = sums.weight + prior
    values, vectors = np.linalg.eigh((curve + curve.T) / 2)
    values = np.maximum(values, 1e-8 * values.max())
    inverse = (vectors / values) @ vectors.T
    pull = sums.effects - prior @ effects
    shift = inverse @ pull
    mode = effects + shift
    value = sums.loglik - effects @ prior @ effects / 2 + pull @ shift / 2 + prior_log / 2 - np.log(values).sum() / 2
    third_params, third_effects = sums.slopes(inverse)
    gradient = sums.gradient + third_params / 2 + sums.cross.T @ (inverse @ third_effects / 2 + shift)
    schur = -sums.curvature - sums.cross.T @ inverse @ sums.cross
    of_kappa, covariance = np.zeros(len(kappa)), np.linalg.inv(prior)
    moved = [covariance @ s @ covariance for s in slopes]
    back = prior - prior @ inverse @ prior
    for m, s in enumerate(slopes):
        of_kappa[m] = (slopes_log[m] - mode @ s @ mode - np.einsum("ij,ji->", inverse, s) - third_effects @ inverse @ s @ mode) / 2
    information = np.array([[np.einsum("ij,ji->", back @ a, back @ b) / 2 for b in moved] for a in moved])
    return value, gradient, schur, of_kappa, information, pull, inverse, [s @ mode for s in slopes]


def bounds_of(randoms: Sequence[Random]) -> tuple[np.ndarray, np.ndarray]:
    ranges = [ATANH_RANGE if name == "atanh_r" else LOG_SD_RANGE for r in randoms for name in r.names]
    return np.array([a for a, _ in ranges]), np.array([b for _, b in ranges])


def advance(layout: Layout):
    """One safeguarded step for a batch of models, each from its own sums."""
    size, full = layout.terms + 1, layout.terms + 3
    low, high = bounds_of(layout.randoms)
    low, high = np.concatenate(([LOG_THETA_RANGE[0], ZETA_RANGE[0]], low)), np.concatenate(([LOG_THETA_RANGE[1], ZETA_RANGE[1]], high))
    held = len(low)

    def pinned(point, slope):
        return ((point <= low) & (slope < 0)) | ((point >= high) & (slope > 0))

    def aimless(kappa: np.ndarray) -> np.ndarray:
        names, out = [n for r in layout.randoms for n in r.names], []
        small = [n != "atanh_r" and k < LEAST_LOG_SD for n, k in zip(names, kappa)]
        for r in layout.randoms:
            at = len(out)
            out += [n == "atanh_r" and any(small[at: at + len(r.names)]) for n in r.names]
        return np.array(out)

    def to_mode(point: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = point.copy()
        moved[size + held:] += shift / max(1.0, np.abs(shift).max() / LONGEST_STEP)
        return moved

    def step_one(row: dict) -> dict:
        point, sizes = np.asarray(row["point"], float), list(row["sizes"])
        kappa, effects = point[full: size + held], point[size + held:]
        cells = np.asarray(row["cells"], np.int64)
        sums = Sums(layout, sizes, cells, np.asarray(row["sums"], float).reshape(len(cells), -1))
        value = -np.inf
        if np.isfinite(sums.loglik):
            value, gradient, schur, of_kappa, information, pull, inverse, pulls = laplace(sums, layout.randoms, sizes, kappa, effects)
            shift = inverse @ pull
        base = row["base_value"]
        row["steps"] += 1
        row["done"] = row["steps"] >= MAX_STEPS
        gap = shift @ pull if np.isfinite(value) else np.inf
        if FAR * (1 + len(effects)) < gap < np.inf and np.isfinite(base) and row["inner"] < MOST_INNER:
            row["inner"] += 1
            row["point"] = to_mode(point, shift)
            return row
        if not (np.isfinite(value) and (np.isneginf(base) or value >= base - 1e-9 * (1 + abs(base)))):
            row["inner"] = 0
            if row["base_gap"] > NEAR:  # the base may have looked better than it is: look again, nearer to its mode
                row["point"], row["base_value"], row["base_gap"] = np.asarray(row["base"], float), -np.inf, 0.0
                return row
            row["halvings"] += 1
            row["step"] = np.asarray(row["step"], float) / 2
            row["point"] = np.asarray(row["base"], float) + row["step"]
            row["done"] |= row["halvings"] > MAX_HALVINGS
            return row
        family, mask = row["family"], int(row["mask"])
        free = np.array([True] + [bool(mask >> j & 1) for j in range(layout.terms)] + [family >= 1, family >= 2])
        stuck = pinned(point[size: size + held], np.concatenate((gradient[size:], of_kappa)))
        free[size:] &= ~stuck[:2]
        stuck[2:] |= aimless(kappa)
        newton, covariance = solved(schur, gradient, free)
        vary, _ = solved(information, of_kappa, ~stuck[2:])
        scale = min(1.0, LONGEST_STEP / max(np.abs(newton).max(), np.abs(vary).max(initial=0.0), 1e-300))
        gain = np.where(free, gradient, 0.0) @ newton + of_kappa @ vary + shift @ pull
        newton, vary = scale * newton, scale * vary
        follow = shift + inverse @ (sums.cross @ newton - sum(v * p for v, p in zip(vary, pulls)))
        step = np.concatenate((newton, vary, follow))
        target = point + step
        target[size: size + held] = np.clip(target[size: size + held], low, high)
        row["base"], row["base_value"], row["base_gap"], row["halvings"], row["inner"] = to_mode(point, shift), value, gap, 0, 0
        row["step"] = target - row["base"]
        row["converged"] = bool(gain < TOLERANCE)
        row["done"] |= row["converged"]
        row["point"], row["loglik"] = (point if row["converged"] else target), value
        row["vcov"] = covariance[:size, :size].ravel()
        return row

    def steps(batches):
        for pdf in batches:
            out = [row if row["done"] else step_one(row) for row in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=_STATE_COLUMNS)

    return steps


class MixedFrame(NamedTuple):
    """A design made ready for any number of fits, with its levels."""

    blocks: DataFrame
    moments: DataFrame
    layout: Layout


def _level_names(randoms: Sequence[Random]) -> list[str]:
    return [f"r{k}" for k in range(len(randoms))]


def prepare(frame: DataFrame, randoms: Sequence[Random], by: str = "species", terms: Sequence[str] = tuple(TERMS)) -> MixedFrame:
    """Settle a model frame as blocks of standardised terms with the codes of each row's levels.

    Rows without a level, and groups without a single bird, have no part in a fit.
    """
    terms, levels = list(terms), _level_names(randoms)
    ties, x = [f"c{k}" for k in range(len(randoms))], [f"x{i}" for i in range(1, len(terms) + 1)]
    kept = frame.dropna("any", subset=[r.column for r in randoms]).withColumns({t: F.col(r.column) for t, r in zip(ties, randoms)})
    table = settle(design(settle(kept, "frame"), by, terms, ties), "design")
    found = [
        (F.sequence(F.min(t), F.max(t)) if r.kind == "ar1" else F.sort_array(F.collect_set(t))).alias(name)
        for name, t, r in zip(levels, ties, randoms)]
    sizes = F.array(*[F.size(name) for name in levels])
    moments = settle(cm.group_moments(table).join(table.groupBy("group").agg(*found), "group").withColumn("sizes", sizes), "moments")
    most = moments.agg(F.max(sum(r.width * F.get("sizes", k) for k, r in enumerate(randoms)))).first()[0] or 0
    if most > MOST_EFFECTS:
        raise ValueError(f"a group has {most} effects; a model's equations hold at most {MOST_EFFECTS}")
    slope = next((terms.index(r.slope) + 1 for r in randoms if r.kind == "line"), 0)
    layout = Layout(len(terms), tuple(randoms), slope, True, True)
    codes = [(F.array_position(name, F.col(t)) - 1).cast("int").alias(t) for name, t in zip(levels, ties)]
    coded = spread(table).join(moments, "group").select("group", "y", *x, "sizes", *codes)

    def blocks(batches):
        for pdf in batches:
            parts = []
            for group, mine in pdf.groupby("group", sort=False):
                for a in range(0, len(mine), BLOCK_ROWS):
                    part = mine.iloc[a: a + BLOCK_ROWS].sort_values(ties)
                    parts.append((group, part[x].to_numpy().ravel(), part["y"].to_numpy(), part[ties].to_numpy().ravel(), part["sizes"].iloc[0]))
            yield pd.DataFrame(parts, columns=["group", "x", "y", "codes", "sizes"])

    schema = "group string, x array<double>, y array<double>, codes array<int>, sizes array<int>"
    packed = coded.sortWithinPartitions("group", *ties).mapInPandas(blocks, schema)
    return MixedFrame(settle(packed, "blocks"), moments, layout)


def full_models(frame: MixedFrame, families: Sequence[str]) -> DataFrame:
    """The model with every term, one per group and family."""
    return cm.full_models(frame.moments, families, frame.layout.terms)


def _start(layout: Layout):
    """The first point: coefficients as given, modest variances, effects at 0; a whole point is taken as it is."""
    first = [FIRST_LOG_SD if name != "atanh_r" else 0.0 for r in layout.randoms for name in r.names]

    def starts(batches):
        for pdf in batches:
            points = []
            for given, sizes in zip(pdf["start"], pdf["sizes"]):
                q = sum(r.width * n for r, n in zip(layout.randoms, sizes))
                whole = len(given) > layout.terms + 3
                points.append(np.asarray(given, float) if whole else np.concatenate((np.asarray(given, float), first, np.zeros(q))))
            yield pd.DataFrame({
                **{c: pdf[c] for c in ("group", "model_id", "family", "mask")}, "point": points, "base": points, "step": [np.zeros(len(p)) for p in points],
                "base_value": -np.inf, "base_gap": 0.0, "halvings": 0, "inner": 0, "steps": 0, "done": False, "converged": False, "n": pdf["n"], "sizes": pdf["sizes"],
                "loglik": None, "vcov": None})

    return starts


def fit(frame: MixedFrame, models: DataFrame, families: Sequence[str]) -> DataFrame:
    """Fit every row of ``models`` (``group, model_id, family, mask, start``) on a prepared frame.

    ``start`` is a whole point (see ``point`` below) or NULL; then the fit starts from that without random terms. Returns one row per model: ``group, model_id, family, mask, n, k, loglik, converged, steps, beta, log_theta, zeta, vcov,
    variances, effects, sizes`` and ``point``. ``k`` counts the variance parameters; ``vcov`` is that of the coefficients given the
    variances. A model that did not converge stays, with ``converged`` false.
    """
    blocks, moments, layout = frame
    layout = layout._replace(negbin=any(f != "poisson" for f in families), inflated="nbinom+zi" in families)
    open_ = models.filter("start is null")
    if not open_.isEmpty():
        plain = cm.fit_counts(cm.CountFrame(blocks, moments, layout.terms), open_, families, covariance=False)
        begun = plain.filter("beta is not null").select("group", "model_id", F.concat("beta", F.array(
            F.coalesce("log_theta", F.lit(0.0)), F.coalesce("zeta", F.lit(0.0)))).alias("first"))
        models = models.join(begun, ["group", "model_id"], "left").withColumn("start", F.coalesce("start", "first"))
    begun = models.filter("start is not null").join(moments.select("group", "n", "sizes"), "group")
    state = settle(begun.mapInPandas(_start(layout), STATE), "fit")
    names, move = layout.names(), advance(layout)
    full = layout.terms + 3
    first_effect = full + sum(len(r.names) for r in layout.randoms)
    sums = F.array(*[F.sum(F.get("sums", i)) for i in range(len(names))]).alias("sums")
    for _ in range(MAX_STEPS):
        running = F.sort_array(F.collect_list(F.struct("model_id", "family", "point")))
        listed = state.filter(~F.col("done")).groupBy("group").agg(running.alias("m")).select(
            "group", F.col("m.model_id").alias("model_id"), F.col("m.family").alias("family"),
            F.flatten(F.transform("m.point", lambda p: F.slice(p, 1, full))).alias("params"),
            F.flatten(F.transform("m.point", lambda p: F.slice(p, first_effect + 1, F.size(p) - first_effect))).alias("effects"))
        summed = blocks.join(listed, "group").mapInPandas(partial_sums(layout), PARTIAL).groupBy("group", "model_id", "cell").agg(sums)
        cells = summed.groupBy("group", "model_id").agg(F.sort_array(F.collect_list(F.struct("cell", "sums"))).alias("c")).select(
            "group", "model_id", F.col("c.cell").alias("cells"), F.flatten("c.sums").alias("sums"))
        state = settle(state.join(cells, ["group", "model_id"], "left").mapInPandas(move, STATE), "fit")
        if state.filter(~F.col("done")).isEmpty():
            break
    family, terms = F.col("family"), layout.terms
    return state.select(
        "group", "model_id", F.element_at(F.array(*[F.lit(FAMILY_NAMES[i]) for i in range(3)]), family + 1).alias("family"), "mask", "n",
        (1 + F.bit_count("mask") + family + (first_effect - full)).cast("int").alias("k"), "loglik", "converged", "steps",
        F.slice("point", 1, terms + 1).alias("beta"), F.when(family >= 1, F.get("point", terms + 1)).alias("log_theta"),
        F.when(family == 2, F.get("point", terms + 2)).alias("zeta"), "vcov",
        F.slice("point", full + 1, first_effect - full).alias("variances"),
        F.slice("point", first_effect + 1, F.size("point") - first_effect).alias("effects"), "sizes", "point")


def fit_families(
    frame: DataFrame, families: Sequence[str], randoms: Sequence[Random] = (OBSERVER,), by: str = "species", terms: Sequence[str] = tuple(TERMS)
) -> DataFrame:
    """Full model of each family for every group, with its random terms."""
    ready = prepare(frame, randoms, by, terms)
    return fit(ready, full_models(ready, families), families)


def select(
    frame: DataFrame, family: str, randoms: Sequence[Random] = (OBSERVER,), by: str = "species", terms: Sequence[str] = tuple(TERMS)
) -> DataFrame:
    """Every allowed subset of the terms with the random terms in all of them, ranked by AICc per group.

    Subsets start from the full model with its effects and variances, at their terms' expense.
    """
    from tallywing.operators.selection import model_space, rank_models, scores_of

    terms = list(terms)
    ready = prepare(frame, randoms, by, terms)
    whole = fit(ready, full_models(ready, [family]), [family]).filter("converged")
    size = len(terms) + 1

    def starts(batches):
        for pdf in batches:
            points = []
            for mask, point, vcov in zip(pdf["mask"], pdf["point"], pdf["vcov"]):
                point, vcov = np.array(point, float), np.array(vcov, float).reshape(size, size)
                out = [j for j in range(1, size) if not (int(mask) >> (j - 1)) & 1]
                if out:
                    point[:size] -= vcov[:, out] @ np.linalg.lstsq(vcov[np.ix_(out, out)], point[out], rcond=None)[0]
                    point[out] = 0.0
                points.append(point)
            yield pd.DataFrame({"group": pdf["group"], "model_id": pdf["mask"], "family": FAMILIES[family], "mask": pdf["mask"], "start": points})

    candidates = model_space(whole.select("group", "point", "vcov"), terms).mapInPandas(
        starts, "group string, model_id int, family int, mask int, start array<double>")
    return rank_models(scores_of(fit(ready, settle(candidates, "candidates"), [family])))


def effects_by_level(fits: DataFrame, frame: MixedFrame) -> DataFrame:
    """Long table ``(group, model_id, family, term, level, effect, slope)``: what each level of each random term adds."""
    levels = frame.moments.select("group", *[F.transform(t, lambda v: v.cast("string")).alias(t) for t in _level_names(frame.layout.randoms)])

    def named(random: Random, first):
        def entry(level, i):
            at = first + random.width * i
            slope = F.get("effects", at + 1) if random.width == 2 else F.lit(None).cast("double")
            return F.struct(F.lit(random.column).alias("term"), level.alias("level"), F.get("effects", at).alias("effect"), slope.alias("slope"))

        return entry

    rows, first = [], F.lit(0)
    for k, random in enumerate(frame.layout.randoms):
        rows.append(F.transform(F.col(f"r{k}"), named(random, first)))
        first = first + random.width * F.size(f"r{k}")
    joined = fits.filter("converged").join(levels, "group")
    return joined.select("group", "model_id", "family", F.explode(F.flatten(F.array(*rows))).alias("e")).select("group", "model_id", "family", "e.*")
