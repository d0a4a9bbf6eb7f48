"""Random effects: the Laplace likelihood against a dense one, its gradient against differences, fits against a plain search."""

import math

import numpy as np
import pytest

from tallywing.operators import count_models as cm
from tallywing.operators import mixed_models as mm
from tallywing.operators.mixed_models import Layout, Random

LINES = Random("species", "line", "t1")
CASES = [(mm.OBSERVER,), (mm.OBSERVER, mm.YEARS), (mm.OBSERVER, LINES)]
SIZES = {"observer": 4, "species": 3, "year": 6}
KAPPA = {"level": [-0.7], "ar1": [-0.4, 0.6], "line": [-0.5, -1.0, 0.3]}


def simulate(seed=1, n=150):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    codes = {name: rng.integers(0, size, n) for name, size in SIZES.items()}
    codes["year"][codes["year"] == 2] = 3  # a year without rows
    eta = 1.0 + x @ [0.5, -0.3] + rng.normal(0, 0.5, 4)[codes["observer"]] + rng.normal(0, 0.4, 6)[codes["year"]]
    eta += rng.normal(0, 0.5, 3)[codes["species"]] + rng.normal(0, 0.3, 3)[codes["species"]] * x[:, 0]
    y = np.where(rng.random(n) < 0.2, 0, rng.poisson(rng.gamma(1.5, np.exp(eta) / 1.5))).astype(float)
    return x, codes, y


X, CODES, Y = simulate()


def row_loglik(y, eta, family, params):
    mu, lg = np.exp(eta), np.vectorize(math.lgamma)
    if family == 0:
        return y * eta - mu - lg(y + 1)
    th = math.exp(params[3])
    l = lg(y + th) - lg(th) - lg(y + 1) + th * np.log(th / (th + mu)) + y * np.log(mu / (th + mu))
    pi = 1 / (1 + math.exp(-params[4]))
    return l if family == 1 else np.where(y == 0, np.log(pi + (1 - pi) * np.exp(l)), np.log(1 - pi) + l)


def dense_z(randoms, x, codes):
    parts = []
    for r in randoms:
        hot = np.eye(SIZES[r.column])[codes[r.column]]
        parts.append(np.stack([hot, hot * x[:, [0]]], axis=2).reshape(len(x), -1) if r.kind == "line" else hot)
    return np.hstack(parts)


def dense_covariance(randoms, kappa):
    blocks, at = [], 0
    for r in randoms:
        n, k = SIZES[r.column], kappa[at: at + len(r.names)]
        at += len(r.names)
        sd = math.exp(k[0])
        if r.kind == "level":
            blocks.append(sd**2 * np.eye(n))
        elif r.kind == "ar1":
            blocks.append(sd**2 * math.tanh(k[1]) ** np.abs(np.subtract.outer(np.arange(n), np.arange(n))))
        else:
            c = math.tanh(k[2]) * sd * math.exp(k[1])
            blocks.append(np.kron(np.eye(n), [[sd**2, c], [c, math.exp(2 * k[1])]]))
    total = sum(map(len, blocks))
    out, at = np.zeros((total, total)), 0
    for b in blocks:
        out[at: at + len(b), at: at + len(b)] = b
        at += len(b)
    return out


def dense(randoms, family, params, kappa, x=X, codes=CODES, y=Y):
    """Laplace likelihood from whole matrices; the rows' second derivatives by differences."""
    z, sigma = dense_z(randoms, x, codes), dense_covariance(randoms, kappa)
    fixed, prior, b, e = np.column_stack([np.ones(len(y)), x]) @ params[:3], np.linalg.inv(sigma), np.zeros(z.shape[1]), 1e-4

    def l(eta):
        return row_loglik(y, eta, family, params)

    for _ in range(200):
        eta = fixed + z @ b
        w = -(l(eta + e) - 2 * l(eta) + l(eta - e)) / e**2
        s = (l(eta + e) - l(eta - e)) / (2 * e)
        step = np.linalg.solve(z.T @ (np.maximum(w, 1e-3)[:, None] * z) + prior, z.T @ s - prior @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    eta = fixed + z @ b
    w = -(l(eta + e) - 2 * l(eta) + l(eta - e)) / e**2
    curve = z.T @ (w[:, None] * z) + prior
    return l(eta).sum() - b @ prior @ b / 2 - np.linalg.slogdet(sigma)[1] / 2 - np.linalg.slogdet(curve)[1] / 2


def at_mode(randoms, family, params, kappa):
    """The library's value and gradients at the mode of the effects."""
    layout = Layout(2, tuple(randoms), 1 if any(r.kind == "line" for r in randoms) else 0, True, True)
    sizes = [SIZES[r.column] for r in randoms]
    codes = np.column_stack([CODES[r.column] for r in randoms])
    cell = sum(codes[:, k] << mm.LEVEL_BITS * k for k in range(len(randoms)))
    rows = np.column_stack([np.ones(len(Y)), X])
    b = np.zeros(sum(r.width * n for r, n in zip(randoms, sizes)))
    for _ in range(200):
        cells, sums = np.unique(cell), []
        for c in cells:
            mine = cell == c
            places = mm.effect_places(layout, sizes, codes[mine][:1])[0]
            eta = rows[mine] @ params[:3] + rows[mine][:, layout.parts] @ b[places]
            sums.append(mm.cell_sums(layout, rows[mine], Y[mine], eta[:, None], np.array([family]), params[None])[0])
        value, gradient, schur, of_kappa, _, pull, inverse, _ = mm.laplace(mm.Sums(layout, sizes, cells, np.array(sums)), randoms, sizes, kappa, b)
        if np.abs(pull).max() < 1e-10:
            break
        b = b + inverse @ pull
    return value, gradient, of_kappa


@pytest.mark.parametrize("family", [0, 1, 2])
@pytest.mark.parametrize("case", range(3))
def test_value_and_gradient(case, family):
    randoms = CASES[case]
    params, kappa = np.array([0.9, 0.4, -0.2, 0.3, -1.2]), np.concatenate([KAPPA[r.kind] for r in randoms])
    value, gradient, of_kappa = at_mode(randoms, family, params, kappa)
    assert value == pytest.approx(dense(randoms, family, params, kappa), abs=2e-3)
    for j in range(3 + family):
        move = np.eye(5)[j] * 1e-5
        slope = (at_mode(randoms, family, params + move, kappa)[0] - at_mode(randoms, family, params - move, kappa)[0]) / 2e-5
        assert gradient[j] == pytest.approx(slope, rel=1e-4, abs=1e-4), j
    for j in range(len(kappa)):
        move = np.eye(len(kappa))[j] * 1e-5
        slope = (at_mode(randoms, family, params, kappa + move)[0] - at_mode(randoms, family, params, kappa - move)[0]) / 2e-5
        assert of_kappa[j] == pytest.approx(slope, rel=1e-4, abs=1e-4), j


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("all", f"OB{o}", f"S{s}", int(t) + 2000, float(v), float(a), float(b)) for o, s, t, v, (a, b) in zip(
        CODES["observer"], CODES["species"], CODES["year"], Y, X)]
    rows += [("all", None, "S0", 2001, 3.0, 0.1, 0.1)] + [("none", "OB1", "S1", 2000 + i, 0.0, float(i), -float(i)) for i in range(4)]
    return spark.createDataFrame(rows, "site string, observer string, species string, season int, birds double, t1 double, t2 double").repartition(3)


@pytest.fixture(scope="module")
def fits(frame):
    out = {}
    for case, families in ((0, ["poisson", "nbinom", "nbinom+zi"]), (1, ["nbinom"]), (2, ["nbinom"])):
        randoms = [r._replace(column="season") if r.kind == "ar1" else r for r in CASES[case]]
        out |= {(case, r["family"]): r for r in mm.fit_families(frame, families, randoms, by="site", terms=["t1", "t2"]).collect()}
    return out


@pytest.mark.parametrize("case, family", [(0, "poisson"), (0, "nbinom"), (0, "nbinom+zi"), (1, "nbinom"), (2, "nbinom")])
def test_fit_is_a_maximum(fits, case, family):
    """Nearby points are lower in the dense likelihood, and the fit's own value is the dense one's there."""
    fit = fits[case, family]
    assert fit["group"] == "all" and fit["converged"] and fit["n"] == len(Y)
    scaled = (X - X.mean(axis=0)) / X.std(axis=0, ddof=1)
    code = cm.FAMILIES[family]
    params = np.array([*fit["beta"], fit["log_theta"] or 0.0, fit["zeta"] or 0.0])
    kappa = np.array(fit["variances"])

    def value(point):
        return dense(CASES[case], code, point[:5], point[5:], x=scaled)

    point = np.concatenate((params, kappa))
    best = value(point)
    assert fit["loglik"] == pytest.approx(best, abs=2e-3)
    assert fit["k"] == 3 + code + len(kappa)
    low, high = mm.bounds_of(CASES[case])
    moved = [0, 1, 2, *range(3, 3 + code), *(5 + j for j in range(len(kappa)) if low[j] < kappa[j] < high[j])]
    for j in moved:
        for sign in (-0.1, 0.1):
            assert value(point + sign * np.eye(len(point))[j]) < best + 1e-4, j


def test_tiny_variance_goes_to_its_bound(spark):
    rng = np.random.default_rng(5)
    rows = [("g", f"O{i % 5}", float(y), float(x)) for i, (y, x) in enumerate(zip(np.full(200, 3.0) + rng.integers(-1, 2, 200), rng.normal(size=200)))]
    frame = spark.createDataFrame(rows, "species string, observer string, birds double, t1 double")
    [fit] = mm.fit_families(frame, ["poisson"], terms=["t1"]).collect()
    [plain] = cm.fit_full(frame, ["poisson"], terms=["t1"]).collect()
    assert fit["converged"] and fit["variances"][0] < -4
    assert fit["loglik"] == pytest.approx(plain["loglik"], abs=1e-2) and fit["beta"] == pytest.approx(plain["beta"], abs=1e-3)


def test_too_many_levels_are_refused(frame, monkeypatch):
    monkeypatch.setattr(mm, "MOST_EFFECTS", 3)
    with pytest.raises(ValueError, match="4 effects"):
        mm.prepare(frame, [mm.OBSERVER], by="site", terms=["t1"])


def test_selection_with_an_observer_effect(frame, fits):
    ranked = mm.select(frame, "nbinom", by="site", terms=["t1", "t2"]).collect()
    assert len(ranked) == 4 and {r["left_out"] for r in ranked} == {0}
    assert sum(r["weight"] for r in ranked) == pytest.approx(1)
    full = next(r for r in ranked if r["mask"] == 3)
    assert full["loglik"] == pytest.approx(fits[0, "nbinom"]["loglik"], abs=1e-5)
    assert all(r["loglik"] <= full["loglik"] + 1e-6 for r in ranked)
