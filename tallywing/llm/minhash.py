"""Near-duplicate texts by improved consistent weighted sampling.

A text is its five-word shingles, each weighing its count in the text times its inverse document frequency. Document
frequencies are counted in ``CELLS`` hashed cells, a table of fixed size: a shingle's cell holds at least its own
documents, so passages that many texts share weigh little at any corpus size. Documents are counted once for each group of
near copies, by its representative: else the larger a group, the less what its texts share would weigh beside their edits,
and the stricter ``SIMILAR`` would be. Representatives come from a first pass without weights (see ``representatives``).
Ioffe's sampling gives each
text ``BANDS * ROWS`` samples, two of which agree with a probability equal to the weighted Jaccard similarity; texts that
agree on all samples of a band are candidates, and a candidate pair is a link if its weighted Jaccard similarity,
computed from the whole texts, is at least ``SIMILAR``.

Groups are never expanded into pairs. Equal texts are one node. In a band's bucket every node is compared with one
leader, another one in each band. What that leaves open is a node that is not linked to its leader but may be linked to
another node of the bucket: those are compared too, unless both already are in one class or, as 1 - similarity is a
metric, their similarities to the leader differ by more than ``1 - SIMILAR``. A node is compared with a large class as a
whole, in tiles of texts by matrix products. So every candidate pair is decided, or its classes are already one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywing.llm.common import frugal, settle, worker_keeps

WORDS, SIMILAR, BANDS, ROWS, CELLS, SLOTS = 5, 0.8, 16, 4, 1 << 18, 1 << 15
#: Texts on a side of a tile, and in a bucket whose open pairs are written as rows.
TILE, CROWD = 256, 32
#: Of the first pass: bands and samples of each, and the share of equal samples that makes two texts near copies there.
FIRST_BANDS, FIRST_ROWS, FIRST_ALIKE = 16, 8, 0.6
BUFFER_CHARS, NO_ID = 1 << 20, -(1 << 63)

_rng = np.random.default_rng(5)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 1 << 62)) * 2 + 1)
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 64, 8, dtype=np.uint64)]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _MIX[k]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    steps = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    for s in steps:
        s[0] = 1
    return tuple(np.multiply.accumulate(s) for s in steps)


def shingles(texts: list[bytes], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of each text's distinct shingles of ``words`` words; a shorter text is one shingle, if it has a word."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    size = 1 << max(10, int(len(data)).bit_length())
    powers, inverses = (p[: len(data)] for p in worker_keeps(("powers", size), lambda: _powers(size)))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers, dtype=np.uint64)))
    blank = _BLANK[data]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    word = _mixed((upto[last] - upto[first]) * inverses[first], 0)
    out = []
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(first, np.concatenate(([0], ends)))
    n = max(1, len(word) - words + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(words):
        part = word[j: j + n]
        runs[: len(part)] = _mixed(runs[: len(part)] + part, 1 + j)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a: b - words + 1], return_counts=True))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for j in range(b - a):
                one = _mixed(one + word[a + j: a + j + 1], 1 + j)
            out.append((one, np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def cell_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (_mixed(hashes, 6) >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def _samplers(slots: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of Ioffe's sampling for each slot and sample."""
    rng = np.random.default_rng(11)
    r = rng.gamma(2.0, 1.0, (slots, samples)).astype(np.float32)
    log_c = np.log(rng.gamma(2.0, 1.0, (slots, samples))).astype(np.float32)
    return r, log_c, rng.random((slots, samples), dtype=np.float32)


def band_names(hashes: np.ndarray, weights: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Names of the bands of one text's samples."""
    samples = bands * rows
    r, log_c, beta = worker_keeps(("samplers", SLOTS, samples), lambda: _samplers(SLOTS, samples))
    best = np.full(samples, np.inf, np.float32)
    chosen, level = np.zeros(samples, np.uint64), np.zeros(samples, np.int64)
    slot, log_w = (_mixed(hashes, 7) >> np.uint64(49)).astype(np.int64), np.log(weights).astype(np.float32)
    for a in range(0, len(hashes), 4096):
        at = slot[a: a + 4096]
        rr, bb = r[at], beta[at]
        t = np.floor(log_w[a: a + 4096, None] / rr + bb)
        value = log_c[at] - rr * (t - bb + 1)
        k = value.argmin(axis=0)
        least = value[k, np.arange(samples)]
        better = least < best
        best[better] = least[better]
        chosen[better] = hashes[a + k[better]]
        level[better] = t[k, np.arange(samples)][better].astype(np.int64)
    sample = _mixed(chosen ^ _mixed(level.view(np.uint64), 2), 3).reshape(bands, rows)
    names = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for j in range(rows):
        names = _mixed(names + sample[:, j], 4 + j % 3)
    return names.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _groups(batches, text_at: int):
    """Rows of batches in groups of about ``BUFFER_CHARS`` bytes of text."""
    rows, size = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            rows.append(row)
            size += len(row[text_at] or b"")
            if size >= BUFFER_CHARS:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def plain_samples(hashes: np.ndarray, samples: int) -> np.ndarray:
    """The least of the text's shingles under ``samples`` orders, two of which agree with a probability of the plain Jaccard similarity."""
    one, two = worker_keeps(("orders", samples), lambda: np.random.default_rng(17).integers(0, 1 << 32, (2, samples), dtype=np.uint32) | np.uint32(1))
    short = (_mixed(hashes, 3) >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1024):
        order = short[None, a: a + 1024] * one[:, None]
        order ^= order >> np.uint32(15)
        order *= two[:, None]
        np.minimum(least, order.min(axis=1), out=least)
    return least


def representatives(texts: DataFrame, words: int) -> DataFrame:
    """(doc, node) of texts with words, one of each group of near copies or a few, however large the group is.

    A text is left out if, in a bucket of plain samples, the text with the smallest node is smaller than its own and agrees
    with it on at least ``FIRST_ALIKE`` of all samples. Of texts that agree on a band with probability p about 1 / p stay.
    """
    samples = FIRST_BANDS * FIRST_ROWS

    def sketch(batches):
        for held in _groups(batches, 2):
            found = [plain_samples(h, samples) if len(h) else None for h, _ in shingles([r[2] for r in held], words)]
            kept = [i for i, f in enumerate(found) if f is not None]
            names = np.zeros((len(kept), FIRST_BANDS), np.uint64)
            if kept:
                by_band = np.stack([found[i] for i in kept]).astype(np.uint64).reshape(len(kept), FIRST_BANDS, FIRST_ROWS)
                for j in range(FIRST_ROWS):
                    names = _mixed(names + by_band[:, :, j], 4 + j % 3)
            yield pa.RecordBatch.from_arrays([
                pa.array([held[i][0] for i in kept], pa.int64()), pa.array([held[i][1] for i in kept], pa.binary()),
                pa.array([found[i].astype(np.uint8).tobytes() for i in kept], pa.binary()),
                pa.array(list(names.view(np.int64)), pa.list_(pa.int64()))], names=["doc", "node", "sketch", "bands"])

    drawn = settle(texts.select("doc", "node", "data").mapInArrow(frugal(sketch), "doc long, node binary, sketch binary, bands array<long>"), "near-sketches")
    nodes = settle(drawn.groupBy("node").agg(F.min("doc").alias("doc"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands")), "near-sketched")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "name"))
    led = settle(buckets.groupBy("band", "name").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
                 .select("band", "name", "leader"), "near-first")
    met = settle(buckets.join(led, ["band", "name"]).where("leader < node").select("node", "leader").distinct(), "near-met")
    sketches = nodes.select("node", "sketch")
    both = met.join(sketches, "node").join(sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("theirs")), "leader")

    def alike(batches):
        for batch in batches:
            same = [np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) >= FIRST_ALIKE * samples
                    for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same, pa.bool_()))], names=["node"])

    copies = both.select("node", "sketch", "theirs").mapInArrow(frugal(alike), "node binary").distinct()
    return settle(nodes.select("doc", "node").join(copies, "node", "left_anti"), "near-representatives")


def cell_weights(texts: DataFrame, words: int, cells: int) -> np.ndarray:
    """ln(1 + documents / documents in the cell) for each cell, from the representatives of ``texts`` (data binary, and doc
    and node where it has them)."""
    if "node" not in texts.columns:
        texts = texts.select(F.lit(NO_ID).alias("doc"), F.unhex(F.md5("data")).alias("node"), "data")
    chosen = representatives(texts, words)

    def count(batches):
        total = np.zeros(cells, np.int64)
        for rows in _groups(batches, 0):
            for hashes, _ in shingles([r[0] for r in rows], words):
                total[np.unique(cell_of(hashes, cells))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    once = texts.join(chosen, ["doc", "node"]).groupBy("doc", "node").agg(F.first("data").alias("data")).select("data")  # repeated rows once
    counts = settle(once.mapInArrow(frugal(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "near-cells").toPandas()
    found = np.zeros(cells)
    found[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return np.log1p(max(1, chosen.count()) / np.maximum(found, 1)).astype(np.float32)


def _links(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, words: int) -> DataFrame:
    """(a, b, similar) of pairs (a, b) of nodes, from the whole texts (node, data)."""

    def compare(batches):
        kept: dict[bytes, tuple] = {}

        def vector(node, data):
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                hashes, counts = shingles([data], words)[0]
                kept[node] = hashes, counts * weights[cell_of(hashes, len(weights))].astype(np.float64)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [similarity(vector(x, batch.column(2)[i].as_py()), vector(y, batch.column(3)[i].as_py())) for i, (x, y) in enumerate(zip(a, b))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similar"])

    one = texts.select(F.col("node").alias("a"), F.col("data").alias("data_a"))
    two = texts.select(F.col("node").alias("b"), F.col("data").alias("data_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "data_a", "data_b")
    return settle(both.mapInArrow(frugal(compare), "a binary, b binary, similar double"), "near-links")


def tile_links(left: list[tuple], right: list[tuple], similar: float, every: bool) -> list[tuple[bytes, bytes]]:
    """For each (node, vector) of ``left`` its links to ``right``, or the first found of them unless ``every``; vectors are
    (hashes, counts, weight of each).

    A hash that a text holds n times counts as n elements of its weight, so that what two texts share is one matrix product.
    """
    def elements(vectors):
        own, weight, of = [], [], []
        for i, (hashes, counts, each) in enumerate(vectors):
            turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            own.append(np.repeat(hashes, counts) ^ _mixed(turn.astype(np.uint64), 5))
            weight.append(np.repeat(each, counts))
            of.append(np.full(len(own[-1]), i))
        return np.concatenate(own), np.concatenate(weight), np.concatenate(of)

    x, wx, i = elements([v for _, v in left])
    y, wy, j = elements([v for _, v in right])
    common = np.intersect1d(x, y)
    shared = np.zeros((len(left), len(right)))
    column_x, column_y = np.searchsorted(common, x), np.searchsorted(common, y)
    held_x = (column_x < len(common)) & (common[np.minimum(column_x, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool)
    held_y = (column_y < len(common)) & (common[np.minimum(column_y, len(common) - 1)] == y) if len(common) else np.zeros(len(y), bool)
    for a in range(0, len(common), 4096):
        mine, theirs = held_x & (column_x >= a) & (column_x < a + 4096), held_y & (column_y >= a) & (column_y < a + 4096)
        one, two = np.zeros((len(left), 4096)), np.zeros((len(right), 4096))
        one[i[mine], column_x[mine] - a] = wx[mine]
        two[j[theirs], column_y[theirs] - a] = 1
        shared += one @ two.T
    total_x, total_y = np.bincount(i, wx, len(left)), np.bincount(j, wy, len(right))
    score = shared / (total_x[:, None] + total_y[None, :] - shared)
    out = []
    for k, (node, vector) in enumerate(left):
        for m in np.argsort(-score[k], kind="stable"):
            if score[k, m] < similar - 1e-6:
                break
            other, theirs = right[m]
            if other != node and similarity((vector[0], vector[1] * vector[2]), (theirs[0], theirs[1] * theirs[2])) >= similar:
                out.append((node, other))
                if not every:
                    break
    return out


def _tile_links(asked: DataFrame, held: DataFrame, texts: DataFrame, weights: np.ndarray, words: int, similar: float, every: bool) -> DataFrame:
    """(a, b): links of the nodes of ``asked`` (unit, node) to those of ``held`` with the same unit, in tiles of about ``TILE`` by ``TILE`` texts."""
    def blocks(frame):
        n = settle(frame.groupBy("unit").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n")), "near-units")
        return n, frame.join(n, "unit").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    held = held.join(asked.select(F.col("unit").alias("unit")).distinct(), "unit", "left_semi")
    (asked_n, asked), (held_n, held) = blocks(asked), blocks(held)
    other = F.explode(F.sequence(F.lit(0), F.col("n2") - 1))
    left = asked.join(held_n.withColumnRenamed("n", "n2"), "unit").select("unit", "node", F.col("mine").alias("x"), other.alias("y"))
    right = held.join(asked_n.withColumnRenamed("n", "n2"), "unit").select("unit", "node", F.col("mine").alias("y"), other.alias("x"))
    left, right = (settle(t, "near-tiles").join(texts.select(F.col("node").alias("n"), F.col("data").alias("d")), F.col("node") == F.col("n"))
                   .select(*[F.col(c).alias(c) for c in ("unit", "x", "y", "node")], F.col("d").alias("data")) for t in (left, right))

    def tile(mine, theirs):
        def vectors(table):
            data = table.column("data").to_pylist()
            return [(node, (h, n, weights[cell_of(h, len(weights))].astype(np.float64)))
                    for node, (h, n) in zip(table.column("node").to_pylist(), shingles(data, words))]

        found = tile_links(vectors(mine), vectors(theirs), similar, every) if mine.num_rows and theirs.num_rows else []
        columns = list(zip(*found)) or [(), ()]
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    at = ("unit", "x", "y")
    return settle(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(tile, "a binary, b binary"), "near-tile-links")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node of ``links`` (a, b): the smallest node it is connected to.

    Each round a node takes the smallest label among its neighbours' and then its label's label; rounds are written to
    the shared folder. A chain of n nodes takes about log n rounds.
    """
    both = settle(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))), "near-both")
    labels = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("class")), "near-class")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("class").alias("near"))
        step = settle(labels.join(near, "node").select("node", F.least("class", "near").alias("next"), "class"), "near-step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        jumped = step.join(jump, "next").select("node", F.least("next", "far").alias("class"), (F.least("next", "far") != F.col("class")).alias("moved"))
        new = settle(jumped, "near-class")
        labels = new.select("node", "class")
        if new.where("moved").isEmpty():
            return labels


def placed_nodes(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(doc_id, node, class, bare) of every row: the text's md5, the smallest md5 of its class, and whether it has no words."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.unhex(F.md5(data)).alias("node"), data.alias("data"))
    weights = cell_weights(texts, words, cells)

    def sign(batches):
        for held in _groups(batches, 2):
            names = [band_names(h, n * weights[cell_of(h, cells)], bands, rows) if len(h) else None
                     for h, n in shingles([r[2] for r in held], words)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()),
                pa.array(names, pa.list_(pa.int64()))], names=["doc", "node", "bands"])

    signed = settle(texts.mapInArrow(frugal(sign), "doc long, node binary, bands array<long>"), "near-signed")
    nodes = settle(signed.where("bands is not null").groupBy("node").agg(F.min("doc").alias("doc"), F.min("bands").alias("bands")), "near-nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "name"))
    turn = F.struct(F.xxhash64("node", "band").alias("turn"), "node")
    led = settle(buckets.groupBy("band", "name").agg(F.min(turn).alias("first"), F.count("*").alias("n")).where("n > 1")
                 .select("band", "name", F.col("first.node").alias("leader")), "near-leaders")
    members = settle(buckets.join(led, ["band", "name"]).where("node <> leader"), "near-members")
    ordered = (F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    pairs = settle(members.select(*ordered).distinct(), "near-pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc"), "node")
    known = texts.join(wanted, ["doc", "node"]).groupBy("doc", "node").agg(F.first("data").alias("data"))  # repeated rows once
    known = settle(known.select("node", "data"), "near-texts")
    compared = _links(pairs, known, weights, words)
    links = compared.where(F.col("similar") >= similar)
    label = components(links)

    # What the leaders leave open: a node not linked to its leader, and another class of the bucket with a member whose
    # similarity to the leader allows a link. Small classes are compared pair by pair, large ones in tiles.
    scored = members.withColumn("a", ordered[0]).withColumn("b", ordered[1]).join(compared, ["a", "b"]).select("band", "name", "node", "similar")
    sizes = label.groupBy("class").agg(F.count("*").alias("many"))
    sized = settle(label.join(sizes, "class").select("node", "class", "many"), "near-sized")
    scored = settle(scored.join(sized, "node", "left").select("band", "name", "node", "similar", F.coalesce("class", "node").alias("class"),
                                                              F.coalesce("many", F.lit(1)).alias("many")), "near-scored")
    slack = 1 - similar + 1e-9
    # of a large class in a bucket, one row: its least and largest similarity to the leader
    large = F.col("many") > TILE
    wide = scored.where(large).groupBy("band", "name", F.col("class").alias("class2")).agg(
        F.min("similar").alias("low"), F.max("similar").alias("high"))
    open_ = ((F.col("class") != F.col("class2")) & (F.least("similar", "low") < similar)
             & (F.col("similar") >= F.col("low") - slack) & (F.col("similar") <= F.col("high") + slack))
    tiled = settle(scored.join(wide, ["band", "name"]).where(open_).select("node", F.col("class2").alias("unit")).distinct(), "near-tiled")
    # nodes of small classes: pair by pair in a small bucket, in tiles in a large one
    narrow = scored.where(~large)
    crowd = narrow.groupBy("band", "name").agg(F.count("*").alias("n"), F.min("similar").alias("least"), F.countDistinct("class").alias("classes"))
    narrow = settle(narrow.join(crowd.where("classes > 1").where(F.col("least") < similar).drop("least", "classes"), ["band", "name"]), "near-narrow")
    other = narrow.where(F.col("n") <= CROWD).select(
        "band", "name", F.col("node").alias("node2"), F.col("similar").alias("similar2"), F.col("class").alias("class2"))
    near = (F.col("class") != F.col("class2")) & (F.abs(F.col("similar") - F.col("similar2")) <= slack)
    once = (F.col("similar2") >= similar) | (F.col("node") < F.col("node2"))
    more = narrow.where((F.col("n") <= CROWD) & (F.col("similar") < similar)).join(other, ["band", "name"]).where(near & once).select(
        F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    rest = settle(more.join(pairs, ["a", "b"], "left_anti"), "near-rest")
    crowded = settle(narrow.where(F.col("n") > CROWD).select(F.xxhash64("band", "name").alias("unit"), "node").distinct(), "near-crowded")
    found = [links]
    if not rest.isEmpty():
        found.append(_links(rest, known, weights, words).where(F.col("similar") >= similar).select("a", "b"))
    if not tiled.isEmpty():
        members_of = sized.where(F.col("many") > TILE).select(F.col("class").alias("unit"), "node")
        found.append(_tile_links(tiled, members_of, known, weights, words, similar, every=False))
    if not crowded.isEmpty():
        found.append(_tile_links(crowded, crowded, known, weights, words, similar, every=True))
    if len(found) > 1:
        label = components(reduce(DataFrame.unionByName, [f.select("a", "b") for f in found]))

    return settle(signed.join(label.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "node", F.coalesce("class", "node").alias("class"),
        F.col("bands").isNull().alias("bare")), "near-placed")


def classes(docs: DataFrame, similar: float = SIMILAR, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """(doc_id, node, class_id, class_size) of every row of ``docs``.

    ``class_id`` is the smallest doc_id of the texts that links connect, NULL if none has an id; ``class_size`` counts its
    rows. ``node`` is the md5 of the text. Equal texts are one class. A NULL text and a text without words are classes of
    their own (their own id, size 1). Repeated rows count each. An empty table gives no rows.
    """
    placed = placed_nodes(docs, similar, words, bands, rows, cells)
    size = placed.where("not bare").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    whole = placed.where("not bare").join(settle(size, "near-classes"), "class").select("doc_id", "node", "class_id", "class_size")
    return whole.unionByName(placed.where("bare").select("doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs``, all columns, one row of each class: the text with the smallest id, and of repeated rows any one.

    Rows whose text has no words stay. Where no text of a class has an id, the text with the smallest md5 stays.
    """
    placed = placed_nodes(docs.select("doc_id", "text"), **parameters).withColumn("d", F.coalesce(F.col("doc_id"), F.lit(NO_ID)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "d", F.col("node").alias("m"))).alias("f")
    kept = placed.where("not bare").groupBy("class").agg(first).select("f.d", "f.m", F.lit(True).alias("once"))
    bare = placed.where("bare").select("d", F.col("node").alias("m"), F.lit(False).alias("once")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
                       F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("m"))
    joined = rows.join(settle(kept.unionByName(bare), "near-kept"), ["d", "m"])
    one = F.row_number().over(Window.partitionBy("d", "m").orderBy("d"))
    return joined.withColumn("one", one).where("one = 1 or not once").select("row.*")
