"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins and so has each of a few pairs of features. The tables are learned by
cyclic boosting: round after round, feature after feature, a shallow tree on that one feature (then on that pair) is
fitted to what the model leaves unexplained and added to the table at a small rate. Fitting takes a bounded sample of
labelled documents (``SAMPLE``, those with the smallest hash of their id); a score is a sum of table lookups, which Spark
evaluates as expressions over literal arrays, text statistics included, without Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import labels_of, settle
from tallywing.llm.textstats import FEATURES, features, with_statistics

#: Labelled rows a fit takes at most; bins of a feature, and of a feature in a pair.
SAMPLE, BINS, PAIR_BINS = 40_000, 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, RIDGE = 120, 60, 6, 0.15, 3, 1.0
KEEP_AT = 0.7


@dataclass
class Model:
    """Log odds: ``base`` plus one table entry per feature and per pair. ``cuts[f]`` are the upper bounds of its bins."""

    base: float
    names: tuple[str, ...] = FEATURES
    cuts: list[list[float]] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[list[float]] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], x[:, f])]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a]), np.searchsorted(self.pair_cuts[b], x[:, b])]
        return total

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1 as one expression of the feature columns."""

        def cell(value: Column, cuts: list[float]) -> Column:
            return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value > c)) if cuts else F.lit(0)

        def entry(table: np.ndarray, at: Column) -> Column:
            return F.array(*[F.lit(float(v)) for v in table.ravel()])[at]

        total = F.lit(float(self.base))
        for f, table in enumerate(self.tables):
            total = total + entry(table, cell(columns[self.names[f]], self.cuts[f]))
        for a, b, table in self.pairs:
            x, y = cell(columns[self.names[a]], self.pair_cuts[a]), cell(columns[self.names[b]], self.pair_cuts[b])
            total = total + entry(table, x * F.lit(table.shape[1]) + y)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quantile_cuts(values: np.ndarray, bins: int) -> list[float]:
    """Bounds halfway between neighbouring values, about equally many values a bin."""
    seen = np.unique(values)
    if len(seen) < 2:
        return []
    middle = (seen[1:] + seen[:-1]) / 2
    if len(middle) < bins:
        return middle.tolist()
    wanted = np.quantile(values, np.arange(1, bins) / bins)
    return np.unique(middle[np.clip(np.searchsorted(seen, wanted), 0, len(middle) - 1)]).tolist()


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _worth(g, h):
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values per bin of the tree of at most ``leaves`` leaves that greedily lowers the loss, from gradient sums per bin."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = _worth(gl, hl) + _worth(gr, hr) - _worth(cg[b] - cg[a], ch[b] - ch[a])
            gain[(hl < 1e-3) | (hr < 1e-3)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (k, int(m[gain.argmax()])))
        if best[1] is None:
            break
        k, m = best[1]
        parts[k:k + 1] = [(parts[k][0], m), (m, parts[k][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values per cell of the best four-way split of a pair: one cut of the first feature, one of the second."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            quarters = []
            for rows in ((0, i), (i, g.shape[0])):
                for cols in ((0, j), (j, g.shape[1])):
                    s = [c[rows[1], cols[1]] - c[rows[0], cols[1]] - c[rows[1], cols[0]] + c[rows[0], cols[0]] for c in (cg, ch)]
                    quarters.append((rows, cols, *s))
            gain = sum(_worth(q[2], q[3]) for q in quarters) - _worth(cg[-1, -1], ch[-1, -1])
            if gain > best + 1e-9:
                best, out = gain, np.zeros_like(g)
                for rows, cols, a, b in quarters:
                    out[rows[0]:rows[1], cols[0]:cols[1]] = _leaf(a, b)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labels ``y`` (0, 1) on features ``x``; with labels of one kind, or none, a constant."""
    n, ones = len(y), float(y.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if n == 0 or ones in (0, n):
        return Model(base)
    k = x.shape[1]
    model = Model(base, FEATURES[:k], [quantile_cuts(x[:, f], BINS) for f in range(k)])
    model.pair_cuts = [quantile_cuts(x[:, f], PAIR_BINS) for f in range(k)]
    cells = [np.searchsorted(model.cuts[f], x[:, f]) for f in range(k)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    odds = np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * shallow_tree(np.bincount(cells[f], g, size), np.bincount(cells[f], h, size))
            model.tables[f] += step
            odds += step[cells[f]]
    coarse = [np.searchsorted(c, x[:, f]) for f, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def sums(a, b, values):
        return np.bincount(coarse[a] * sizes[b] + coarse[b], values, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((pair_tree(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(k) for b in range(a + 1, k)),
                    key=lambda r: (-r[0], r[1], r[2]))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = RATE * pair_tree(sums(a, b, g), sums(a, b, h))[1]
            table += step
            odds += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing: crc32 of its id as text, modulo 4, is 2. A NULL id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of ``statistics`` (doc_id, stats) that are not held out."""
    rows = statistics.where(~held_out(F.col("doc_id"))).join(labels, "doc_id").select(
        F.xxhash64("doc_id").alias("h"), "doc_id", F.col("label").alias("y"), *[c.alias(n) for n, c in features().items()])
    rows = settle(rows, "gam-labelled")
    n = rows.count()
    if n > sample:  # hashes are even, so this leaves little more than the sample, however many tasks send their rows
        part = min(1.0, (sample + 6 * sample**0.5) / n)
        rows = rows.where(F.shiftrightunsigned("h", 33) < F.lit(part * 2**31))
    got = rows.orderBy("h", "doc_id").limit(sample).toPandas()
    return fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; labels are (doc_id, quality).

    A NULL or empty text has all statistics 0 and is scored by them. Repeated rows score alike; an empty table gives no
    rows. Only text statistics enter a score.
    """
    statistics = settle(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "gam-stats")
    model = learn(statistics, labels_of(labels, "quality"), sample)
    scored = statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(features()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))
