"""Texts of an Arrow batch as one buffer of UTF-8 bytes, and a sparse index between its bytes and code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 4 << 20


class Exceptions:
    """Where the multibyte characters of a buffer start, and how many bytes beyond one each has.

    Stretches of ASCII need no entry: there a position is an offset from the last exception, so a cut costs one binary
    search. Positions are of whole characters.
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)))
        self.point = self.at - self.excess[:-1]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte position."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.excess[np.searchsorted(self.point, point)]


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``batch`` in slices of about ``most`` bytes of text: (rows, the bytes of their texts, where each begins and the last ends).

    A NULL text is empty.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        at = ends[first: last + 1]
        yield batch.slice(first, last - first), data[at[0]: at[-1]], at - at[0]
        first = last
