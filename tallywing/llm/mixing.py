"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in the source's own shuffled order (by a seeded hash) and a virtual finish
time: the source's tokens up to and including it, divided by the source's target. The queue serves documents by finish
time until the total budget is spent, so that every source is served in proportion to its target, whatever the order
in which sources were written. A second pass over a source has the finish times of the first, later by
``source size / target``.

The order inside a source is a two-level running sum: hash ranges of about ``ROWS_A_RANGE`` documents are summed, the
sums are accumulated per source, and documents are accumulated inside their range. A source that holds a third of all
rows is therefore spread over as many tasks as its rows ask for. The cut-off is found by narrowing a histogram of
finish times, never by sorting all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywing.llm.common import settle, word_count

#: Fixed: the mix of the query.
WEIGHTS, SHARE, MOST_PASSES = (3.0, 1.0, 2.0), 1.5, 2
ROWS_A_RANGE, CELLS = 4096, 2048


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most_passes: int = MOST_PASSES) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, n_docs, source_size), one row per source, NULL a source too.

    Sources in code-point order, NULL last, weigh ``weights`` in turn. ``share`` of all tokens is given out by weight; a
    target stops at ``most_passes`` times its source and the excess is given to the others by weight until none is
    above. With T(level) the sum of min(level * weight, limit), the level is that at which the budget is met: sources
    in order of limit / weight, the first whose limit the level does not reach decides. The windows run over sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.orderBy("at", "weight", F.col("source").isNull(), "source")
    before, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weighed = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most_passes)) * F.col("source_size"))
    levels = weighed.withColumn("at", F.col("most") / F.col("weight")).withColumns({
        "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "budget": F.lit(float(share)) * F.sum("source_size").over(whole),
    })
    # while the sources before are at their limit, this is the level that spends the rest
    levels = levels.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    # past the source that decides, levels only fall
    found = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(whole)
    target = F.least(F.col("most"), F.coalesce(found * F.col("weight"), F.col("most")))
    return levels.select("source", "n_docs", "source_size", target.alias("target"))


def place(seed: int) -> Column:
    """Where a document stands in the shuffled order of its source: 63 bits of a seeded hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` (source, doc_id, place, size, n_docs, ..) with ``upto``: the source's sizes in order of (place, doc_id),
    this row's included; rows of one doc_id have the same."""
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_A_RANGE))
    spread = rows.withColumn("range", F.floor(F.shiftright("place", 32) * ranges / F.lit(2**31)).cast("long"))
    sums = spread.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("place", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.withColumn("inside", F.sum("size").over(inside))
    return placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn(
        "upto", F.col("base") + F.col("inside")).drop("s", "r", "base", "inside", "range")


def cut_off(finish: DataFrame, budget: float) -> float:
    """The largest finish time up to which the sizes of (finish, size) sum to at most ``budget``; -1.0 if none does.

    Each round sums sizes in at most ``CELLS`` cells of the range left and goes on inside the cell where the budget
    ends, until that cell holds one finish time: at most ``CELLS`` rows reach the driver a round.
    """
    low, spent = -1.0, 0.0
    span = finish.agg(F.min("finish").alias("a"), F.max("finish").alias("b")).first()
    if span["a"] is None:
        return low
    a, b = span["a"], span["b"]
    while True:
        width = (b - a) / CELLS or 1.0
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("finish") - F.lit(a)) / F.lit(width)).cast("int"))
        cells = finish.where(F.col("finish").between(a, b)).groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("sum"), F.min("finish").alias("least"), F.max("finish").alias("most")).orderBy("cell").collect()
        for c in cells:
            if spent + c["sum"] > budget:
                break
            spent, low = spent + c["sum"], c["most"]
        else:
            return low
        if c["least"] == c["most"]:
            return low
        a, b = c["least"], c["most"]


def serve(docs: DataFrame, weights: tuple[float, ...], share: float, most_passes: int, seed: int) -> tuple[DataFrame, float]:
    """The queue (doc_id, source, size, source_size, target, place, finishes) and the last finish time served."""
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    targets = settle(source_targets(per_source, weights, share, most_passes), "mix-targets")
    named = targets.withColumnRenamed("source", "of")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("place", place(seed))
    served = _running(rows.where("size > 0"))
    passes = F.array(*[(F.col("upto") + F.lit(k) * F.col("source_size")) / F.col("target") for k in range(most_passes)])
    queue = settle(served.withColumn("finishes", F.when(F.col("target") > 0, passes)).unionByName(
        rows.where("size = 0"), allowMissingColumns=True), "mix-queue")
    budget = targets.agg(F.sum("target").alias("b")).first()["b"] or 0.0
    return queue, cut_off(queue.where("size > 0").select("size", F.explode("finishes").alias("finish")), budget)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES,
        seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    ``taken`` is the document's words that the mix takes: its size times the passes that finish by the cut-off, at most
    ``most_passes``. A document without words (NULL or empty text too) takes 0. Rows of one doc_id and source are served
    together. An empty table gives no rows. Reruns agree, because places follow from a seeded hash of doc_id.
    """
    queue, last = serve(docs, weights, share, most_passes, seed)
    taken = F.when(F.col("size") > 0, F.col("size") * F.size(F.filter("finishes", lambda x: x <= F.lit(last)))).otherwise(0)
    return queue.select("doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES,
         seed: int = 17) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all columns, as often as the mix takes it (0 to ``most_passes`` times).

    A source is served in order of place, so one last place per source and pass says which rows are taken. Texts are
    joined to that table of sources, not to the queue of documents.
    """
    queue, last = serve(docs, weights, share, most_passes, seed)
    at = F.struct("place", "doc_id")
    ends = queue.where("size > 0").groupBy(F.col("source").alias("of")).agg(*[
        F.max(F.when(F.element_at("finishes", k + 1) <= F.lit(last), at)).alias(f"end{k}") for k in range(most_passes)])
    here = F.struct(place(seed).alias("place"), F.col("row.doc_id"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").alias("from"), word_count(F.col("text")).alias("size"))
    times = sum((F.coalesce((here <= F.col(f"end{k}")).cast("int"), F.lit(0)) for k in range(most_passes)), F.lit(0))
    joined = rows.where("size > 0").join(settle(ends, "mix-ends"), F.col("from").eqNullSafe(F.col("of"))).withColumn("times", times)
    return joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
