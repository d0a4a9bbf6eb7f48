"""Fill-in-the-middle: a text is cut in three at two code points and laid out with its middle last.

Texts stay UTF-8 bytes. A sparse index of the multibyte characters of a slice of texts turns the cuts, which count code
points, into byte positions by one binary search for all texts at once; between two exceptions a position is plain
arithmetic. Where a text is cut, and which form it gets, follow from a hash of its id, so that reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.codepoints import Exceptions, text_slices
from tallywing.llm.common import frugal

#: Fixed: what marks the parts, in a text of either form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many change their form; of 100 of those, so many begin with the suffix.
CHANGED, SUFFIX_FIRST, SEED = 90, 20, 1

FORMS = ("plain", "psm", "spm")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def marked(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks themselves."""
    found = np.zeros(len(ends) - 1, bool)
    if len(data) >= 3:
        inner = (data[1:-1] == PREFIX[1]) | (data[1:-1] == SUFFIX[1]) | (data[1:-1] == MIDDLE[1])
        at = np.flatnonzero(inner & (data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]))
        text = np.searchsorted(ends, at, "right") - 1
        found[text[at + 3 <= ends[text + 1]]] = True
    return found


def cuts(data: np.ndarray, ends: np.ndarray, h: np.ndarray, changed: int, suffix_first: int):
    """(code points, form, first and second cut in code points, the same in bytes) of each text; ``h`` holds four hashes a text."""
    index = Exceptions(data)
    begin = index.points(ends)
    n = np.diff(begin)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    plain = (n == 0) | marked(data, ends) | (h[:, 2] % 100 >= changed)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < suffix_first, 2, 1))
    return n, form, low, high, index.bytes(begin[:-1] + low), index.bytes(begin[:-1] + high)


def laid_out(data: bytes, form: int, start: int, low: int, high: int, end: int) -> bytes:
    if form == 0:
        return data[start:end]
    prefix, middle, suffix = data[start:low], data[low:high], data[high:end]
    if form == 1:
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def transform(docs: DataFrame, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row for each row of ``docs``.

    ``n`` counts code points; the cuts are NULL for a plain text, whose output is the text itself. A NULL text is empty,
    and an empty one plain; texts without an id are cut as if their id were written as nothing. Repeated rows come out
    alike, an empty table gives no rows. Other columns are not read.
    """

    def rows(batches):
        for batch in batches:
            for part, data, ends in text_slices(batch, 1):
                hashes = bytes.fromhex("".join(part.column(2).to_pylist()))
                h = np.frombuffer(hashes, ">u4").reshape(-1, 8)[:, :4].astype(np.int64)
                n, form, low, high, at_low, at_high = cuts(data, ends, h, changed, suffix_first)
                raw = data.tobytes()
                places = zip(form.tolist(), ends[:-1].tolist(), at_low.tolist(), at_high.tolist(), ends[1:].tolist())
                output = pa.array([laid_out(raw, *p) for p in places], pa.binary()).cast(pa.string())
                plain = form == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(np.array(FORMS)[form], pa.string()), pa.array(low, mask=plain),
                     pa.array(high - low, mask=plain), output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc = F.col("doc_id").cast("long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"), 256)
    return docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("h")).mapInArrow(frugal(rows), SCHEMA)


def restore(made: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``made`` with the text that each output was made of. No text that changed form holds a mark, so the first mark of a kind is the one laid there."""
    first, then = F.col(output), F.col(form)
    body = F.substring(first, 4, 2**31 - 1)
    middle = F.split_part(body, F.lit("<M>"), F.lit(2))
    front = F.split_part(body, F.lit("<M>"), F.lit(1))
    inner = F.when(then == "psm", F.lit("<S>")).otherwise(F.lit("<P>"))
    left, right = F.split_part(front, inner, F.lit(1)), F.split_part(front, inner, F.lit(2))
    text = F.when(then == "plain", first).when(then == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
    return made.withColumn(restored, text)
