"""Ranked lexical search of many items over all documents, with what items share worked out once.

A term's share of a document's score does not depend on the item, so an item's score is a sum over its terms, and a set of
terms that several items hold is a partial sum of all of them. Those sets are mined from the items: terms that stand in the
same items become one node; then the pairs of nodes that most items hold become nodes in turn, until no pair stands in two
items. The nodes are a graph without cycles, whose sums a task works out once for a block of documents, layer by layer:
terms, sets of terms, shared nodes, items. Each task keeps the best documents of every item; those lists are merged.

Items are taken in blocks of bounded size, so what travels to the tasks does not grow with their number. Documents are
read once for a block; frequencies of its terms are written, and serve both the counts over all documents and the scores.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywing.llm.common import frugal, settle
from tallywing.llm.licence import _FOLD
from tallywing.session import scratch_path

#: Text of the items of a block, and sums that a task holds at a time (each eight bytes), and bytes of words split at a time.
BLOCK_BYTES, HELD_SUMS, PART_BYTES = 512 << 10, 4_000_000, 1 << 20
#: Partitions whose lists are merged before all are.
TOGETHER = 256
BEST = 10

COUNTS = "doc_id long, n long, terms array<int>, times array<long>"
FOUND = "item_id long, item long, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in lists, a long text in parts cut between terms."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PART_BYTES else folded.find(b" ", at + PART_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: all its terms, and which of the vocabulary stand in it how often."""

    def rows(batches):
        known = vocabulary.__contains__
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            kept, sizes, ends, terms, times = [], [], [0], [], []
            for i in range(batch.num_rows):
                n, held = 0, Counter()
                for words in terms_of(texts[i].as_py() or b""):
                    n += len(words)
                    held.update(filter(known, words))
                if n:
                    kept.append(i)
                    sizes.append(n)
                    terms += map(vocabulary.__getitem__, held)
                    times += held.values()
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(kept, pa.int32())), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(rows), COUNTS)


def document_counts(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the ``size`` terms."""

    def rows(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["term", "held"])

    summed = counts.select("terms").mapInArrow(rows, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    out = np.zeros(size, np.int64)
    for row in summed.collect():  # at most one row a term of the block
        out[row["term"]] = row["held"]
    return out


class Sharing:
    """What the items of a block share: ``groups`` of terms, ``layers`` of shared nodes, ``items`` as sets of nodes.

    Nodes are numbered groups first, then shared nodes by layer. A layer is (left, right): nodes of earlier layers that it adds.
    """

    def __init__(self, items: list[set[int]]):
        where: dict[int, list[int]] = defaultdict(list)
        for i, terms in enumerate(items):
            for t in sorted(terms):
                where[t].append(i)
        alike: dict[tuple, list[int]] = defaultdict(list)
        for t in sorted(where):
            alike[tuple(where[t])].append(t)
        self.groups = list(alike.values())
        sets = [set() for _ in items]
        for g, held in enumerate(alike):
            for i in held:
                sets[i].add(g)
        pairs = self.merge(sets)
        depth = [0] * len(self.groups)
        for a, b in pairs:
            depth.append(1 + max(depth[a], depth[b]))
        order = sorted(range(len(depth)), key=lambda v: (depth[v], v))
        place = {v: k for k, v in enumerate(order)}
        self.layers = []
        for d in range(1, max(depth, default=0) + 1):
            mine = [pairs[v - len(self.groups)] for v in order if depth[v] == d]
            self.layers.append((np.array([place[a] for a, _ in mine]), np.array([place[b] for _, b in mine])))
        self.items = [sorted(place[v] for v in held) for held in sets]
        self.nodes = len(order)

    def merge(self, sets: list[set[int]]) -> list[tuple[int, int]]:
        """Replace pairs that two sets or more hold by nodes of their own, the commonest first; the new nodes' pairs."""
        made: list[tuple[int, int]] = []
        holders: dict[int, set[int]] = defaultdict(set)
        for i, held in enumerate(sets):
            for v in held:
                holders[v].add(i)
        while True:
            coded = []
            for held in sets:
                shared = np.array(sorted(v for v in held if len(holders[v]) > 1), np.int64)
                left, right = np.triu_indices(len(shared), 1)
                coded.append(shared[left] << 32 | shared[right])
            codes, counts = np.unique(np.concatenate(coded), return_counts=True) if coded else (np.zeros(0, np.int64),) * 2
            least = max(2, int(counts.max(initial=0)) // 2)
            often = np.flatnonzero(counts >= least)
            if not len(often):
                return made
            for k in often[np.argsort(-counts[often], kind="stable")].tolist():
                a, b = int(codes[k]) >> 32, int(codes[k]) & (1 << 32) - 1
                both = holders[a] & holders[b]
                if len(both) < least:
                    continue
                new = len(self.groups) + len(made)
                made.append((a, b))
                for i in both:
                    sets[i] -= {a, b}
                    sets[i].add(new)
                holders[a] -= both
                holders[b] -= both
                holders[new] = set(both)

    def sums(self, shares: np.ndarray) -> np.ndarray:
        """Scores (item, document) from the terms' shares (term, document), whose rows lie group by group."""
        out = np.empty((self.nodes, shares.shape[1]), np.int64)
        n = len(self.groups)
        out[:n] = np.add.reduceat(shares, np.cumsum([0] + [len(g) for g in self.groups[:-1]]), axis=0)
        for left, right in self.layers:
            np.add(out[left], out[right], out=out[n: n + len(left)])
            n += len(left)
        ends = np.cumsum([0] + [len(v) for v in self.items[:-1]])
        return np.add.reduceat(out[np.concatenate(self.items)], ends, axis=0)


class Best:
    """The best documents of each item so far: highest score, then smallest id, a missing id last."""

    def __init__(self, items: int, most: int):
        self.most, self.least = most, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.missing = np.zeros(0, bool)

    def add(self, scores: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        if scores.shape[1] > self.most:
            least = np.maximum(self.least, np.partition(scores, -self.most, axis=1)[:, -self.most])
        else:
            least = self.least
        item, at = np.nonzero(scores >= least[:, None])
        item, score = np.concatenate((self.item, item)), np.concatenate((self.score, scores[item, at]))
        doc, missing = np.concatenate((self.doc, doc[at])), np.concatenate((self.missing, missing[at]))
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, np.int64)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        order, item = order[place < self.most], item[place < self.most]
        self.item, self.score, self.doc, self.missing = item, score[order], doc[order], missing[order]
        full = np.flatnonzero(np.bincount(item, minlength=len(self.least)) == self.most)
        last = np.searchsorted(item, full, "right") - 1
        self.least[full] = self.score[last]


def score_block(counts: DataFrame, items: list[tuple[int | None, int, set[int]]], weights: np.ndarray, documents: int, length: int, most: int) -> DataFrame:
    """(item_id, item, doc_id, score): the best documents of each item in each partition."""
    items = [(i, k, {t for t in terms if weights[t] > 0}) for i, k, terms in items]
    items = [x for x in items if x[2]]
    sharing = Sharing([terms for _, _, terms in items])
    row = np.full(len(weights), -1)
    used = np.array([t for g in sharing.groups for t in g], np.int64)
    row[used] = np.arange(len(used))
    weight = weights[used]
    ids, numbers = pa.array([i for i, _, _ in items], pa.int64()), pa.array([k for _, k, _ in items], pa.int64())
    step = max(1, HELD_SUMS // (len(used) + 2 * sharing.nodes + len(items)))

    def rows(batches):
        best = Best(len(items), most)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                doc, n, terms, times = part.columns
                of = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                at = row[terms.flatten().to_numpy(zero_copy_only=False)]
                mine = at >= 0
                of, at, tf = of[mine], at[mine], times.flatten().to_numpy(zero_copy_only=False)[mine]
                m = 10 + 90 * n.to_numpy() * documents // length
                shares = np.zeros((len(used), part.num_rows), np.int64)
                shares[at, of] = weight[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
                best.add(sharing.sums(shares), doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(best.item)), numbers.take(pa.array(best.item)), pa.array(best.doc, mask=best.missing), pa.array(best.score)],
            names=["item_id", "item", "doc_id", "score"])

    return counts.mapInArrow(frugal(rows), FOUND) if items else counts.sparkSession.createDataFrame([], FOUND)


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int | None, int, set[bytes]]]]:
    """Items (item_id, number, terms) in blocks of bounded size; items of one id and text are one."""
    known = settle(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct(), "items")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    number = 0
    for b in range(blocks):
        block = []
        for row in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect():
            terms = {w for words in terms_of(row["text"].encode()) for w in words}
            if terms:
                block.append((row["item_id"], number, terms))
                number += 1
        if block:
            yield block


def weights_of(held: np.ndarray, documents: int) -> np.ndarray:
    """A term's weight, floor(1000 ln((2N + 2) / (2 df + 1))); 0 where no document holds it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) if df else 0 for df in held.tolist()], np.int64)


def rank(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0, ties by smaller id.

    Documents without a term count nowhere; a NULL text has none. Rows that share an id are documents of their own; a missing
    id comes after all others in a tie. Items that share an id but not a text are ranked each on its own, repeated items once.
    Empty tables give no rows. Columns but ``doc_id``, ``item_id`` and ``text`` are not read.
    """
    spark = docs.sparkSession
    path, written = scratch_path(spark, "ranked"), False
    for block in blocks_of(items):
        words = sorted({w for _, _, terms in block for w in terms})
        vocabulary = {w: k for k, w in enumerate(words)}
        counts = settle(count_terms(docs, vocabulary), "counts")
        documents, length = counts.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        weights = weights_of(document_counts(counts, len(words)), documents)
        numbered = [(i, k, {vocabulary[w] for w in terms}) for i, k, terms in block]
        found = score_block(counts, numbered, weights, documents, length, best)
        found.withColumn("together", F.floor(F.spark_partition_id() / TOGETHER)).write.mode("append").parquet(path)
        written = True
    schema = f"{FOUND}, together long"
    return merged(spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema), best)


def merged(found: DataFrame, best: int) -> DataFrame:
    """The best of the lists that tasks kept, in two steps, so that no task holds the lists of all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "together").orderBy(*order))).where(F.col("rank") <= best)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= best)
    return last.select("item_id", "rank", "doc_id", "score")

