"""Nearest neighbours by a block matrix join.

Vectors are laid in blocks with int8 codes. Blocks of queries meet blocks of candidates in cells of a grid; in a cell,
one product of codes gives every inner product with a bound on what quantisation can have changed. A pair whose upper
bound lies under the query's k-th best lower bound cannot be among the k nearest; the others are computed again from the
original components in double precision and go through a heap per query. The k best of each cell are merged per query.
The result is exact: nothing is sampled or capped, the bound only decides what need not be computed twice.

A cell is at most ``CELL_BLOCKS`` candidate and ``QUERY_BLOCKS`` query blocks on average, so a task's memory does not grow
with the table. Candidates are sent once for each stripe of queries and queries once for each stripe of candidates.
"""

from __future__ import annotations

from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywing.llm.common import frugal, settle

NEAREST, BLOCK_CELLS, MOST_ROWS = 20, 1 << 20, 2048
CELL_BLOCKS, QUERY_BLOCKS = 16, 4
#: Largest number of components whose int8 products single precision adds without rounding.
EXACT_SINGLE = (1 << 24) // (127 * 127)

BLOCKS = "query boolean, dim int, block long, ids binary, codes binary, scales binary, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, score double"


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the step of each vector: a component is within half a step of its code times the step."""
    scales = np.abs(vectors).max(axis=1) / 127.0
    scales[scales < np.finfo(np.float64).tiny] = np.finfo(np.float64).tiny
    return np.clip(np.rint(vectors / scales[:, None]), -127, 127).astype(np.int8), scales


def pack_blocks(batches):
    """Rows (id, is_query, vector) to rows of ``BLOCKS``; vectors that are NULL, zero or not finite are left out."""
    schema = pa.schema([("query", pa.bool_()), ("dim", pa.int32()), ("block", pa.int64())] + [
        (c, pa.binary()) for c in ("ids", "codes", "scales", "vectors")])
    held: dict[tuple[bool, int], list] = {}
    number, base = 0, TaskContext.get().partitionId() << 32

    def block(key):
        nonlocal number
        ids, vectors = zip(*held.pop(key))
        matrix = np.stack(vectors)
        codes, scales = quantise(matrix)
        number += 1
        return pa.RecordBatch.from_pylist([{
            "query": key[0], "dim": key[1], "block": base + number, "ids": np.asarray(ids, "<i8").tobytes(),
            "codes": codes.tobytes(), "scales": scales.tobytes(), "vectors": matrix.tobytes()}], schema=schema)

    for batch in batches:
        ids, asked, vectors = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        flat, ends = vectors.values, vectors.offsets.to_numpy()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        if flat.null_count:
            values[~np.asarray(flat.is_valid())] = np.nan
        for i, (known, there) in enumerate(zip(ids.is_valid().to_pylist(), vectors.is_valid().to_pylist())):
            if not known or not there:
                continue
            v = values[ends[i]:ends[i + 1]]
            if not len(v) or not np.isfinite(v).all() or not v.any():
                continue
            for query in (False, True) if asked[i] else (False,):
                rows = held.setdefault((query, len(v)), [])
                rows.append((ids[i].as_py(), v))
                if len(rows) >= max(16, min(MOST_ROWS, BLOCK_CELLS // len(v))):
                    yield block((query, len(v)))
    for key in list(held):
        yield block(key)


def _unpacked(row: dict) -> tuple:
    d = row["dim"]
    codes = np.frombuffer(row["codes"], np.int8).reshape(-1, d)
    kind = np.float32 if d <= EXACT_SINGLE else np.float64
    return (np.frombuffer(row["ids"], "<i8"), codes.astype(kind), np.abs(codes.astype(np.int32)).sum(axis=1).astype(np.float64),
            np.frombuffer(row["scales"], np.float64), np.frombuffer(row["vectors"], np.float64).reshape(-1, d))


def tile(queries: tuple, candidates: tuple, best: np.ndarray, heaps: list[list], k: int) -> None:
    """Take one tile's candidates into the heaps; ``best`` is each query's lower bound for its k-th nearest so far."""
    q_ids, q_codes, q_norm, q_scale, q_vectors = queries
    c_ids, c_codes, c_norm, c_scale, c_vectors = candidates
    d = q_vectors.shape[1]
    step = q_scale[:, None] * c_scale[None, :]
    near = (q_codes @ c_codes.T) * step
    bound = step * (0.5 * q_norm[:, None] + 0.5 * c_norm[None, :] + 0.25 * d) * (1 + 1e-9) + 1e-300
    low = near - bound
    low[q_ids[:, None] == c_ids[None, :]] = -np.inf
    if len(c_ids) >= k:
        best = np.maximum(best, np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k])
    rows, columns = np.nonzero((near + bound >= best[:, None]) & (q_ids[:, None] != c_ids[None, :]))
    for a in range(0, len(rows), 1 << 18):
        r, c = rows[a: a + (1 << 18)], columns[a: a + (1 << 18)]
        score = np.zeros(len(r))
        for j in range(d):  # one component after the other, so that a score has one value however tiles are cut
            score += q_vectors[r, j] * c_vectors[c, j]
        for i, s, vec in zip(r.tolist(), score.tolist(), c_ids[c].tolist()):
            heap = heaps[i]
            if len(heap) < k:
                heappush(heap, (s, -vec))
            elif (s, -vec) > heap[0]:
                heappushpop(heap, (s, -vec))


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of largest inner product for each row where ``is_query``.

    Candidates are all rows with the query's number of components but those with its own id. Vectors that are NULL,
    zero, empty or hold a NULL or non-finite component take no part, nor do rows without an id. Ties go to the smaller
    id. Repeated rows are candidates each on its own, and repeated query rows get a list each. A query without
    candidates, and an empty table, give no rows.
    """
    rows = vectors.select(F.col(id_column).cast("long"), F.coalesce(is_query, F.lit(False)), F.col(vector).cast("array<double>"))
    blocks = settle(rows.mapInArrow(frugal(pack_blocks), BLOCKS), "ann-blocks")
    n = blocks.agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("c")).first()
    across, down = -(-n["c"] // CELL_BLOCKS) or 1, -(-n["q"] // QUERY_BLOCKS) or 1

    def stripe(count: int) -> Column:
        return F.pmod(F.xxhash64("block"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    candidates = blocks.where(~F.col("query")).select("*", stripe(across).alias("x"), every(down).alias("y"))
    asked = blocks.where("query").select("*", every(across).alias("x"), stripe(down).alias("y"))
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(left, right):
        out = []
        blocks = [left.slice(i, 1) for i in range(left.num_rows)]
        for row in right.to_pylist():
            queries = _unpacked(row)
            heaps: list[list] = [[] for _ in queries[0]]
            best = np.full(len(heaps), -np.inf)
            for part in blocks:
                tile(queries, _unpacked(part.to_pylist()[0]), best, heaps, k)
                best = np.asarray([h[0][0] if len(h) == k else -np.inf for h in heaps])
            for i, heap in enumerate(heaps):
                out += [((row["block"] << 12) + i, int(queries[0][i]), -vec, s) for s, vec in heap]
        columns = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    at = ("dim", "x", "y")
    found = candidates.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(cell, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
