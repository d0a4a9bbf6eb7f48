"""Removal of repeated byte strings, by refinement of q-gram buckets over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the corpus. Every position of a text has
a bucket, that of the q-gram starting there. Buckets are refined as in bucket-pointer refinement: the bucket of twice the
depth at a position is named by the pair of the bucket there and the bucket at a later offset, and the refined buckets
are used again for the next refinement (1, 2, 4, .. 32, 64, then 64 and 64 at offset 36 for 100 bytes). A bucket is
named by a 64-bit hash of that pair instead of a rank, so that all of this is local to a text and only sampled suffixes
need be compared across the corpus.

Sampled suffixes: each string of ``LENGTH`` bytes is represented by the smallest q-gram bucket inside it (the last one of
equals), its anchor. Strings that lie next to each other mostly share their anchor, about one position in 35 is one,
and equal strings have equal anchors. An anchor stands for a stretch of start positions; its context is the bytes those
strings cover, named by the refined buckets at both ends.

1. Equal contexts: all but the first in (doc_id, start) repeat it, with all their strings.
2. Anchors of one q-gram bucket with different contexts (the edges of repeated passages): blocks of ``BLOCK`` of their
   strings are looked for by the bytes the block shares; where those stand twice, the strings are told apart by name,
   and all but the first of each name repeat it.

Copies are first settled inside a task's buffer, so that a group of any size sends at most one row a buffer on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH, Q = 100, 32
#: Strings whose anchors lie equally far in, to this many bytes, are looked for together first.
BLOCK = 8
#: Bytes of text worked on at once, and bits for a position in it.
BUFFER, POSITION_BITS = 1 << 20, 22

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_M = [np.uint64(int(x) | 1) for x in _rng.integers(0, 1 << 64, 12, dtype=np.uint64)]
_SHIFT = np.uint64(29)


def refine(first: np.ndarray, later: np.ndarray, level: int) -> np.ndarray:
    """Names of the buckets of pairs (bucket, bucket at a later offset)."""
    name = first * _M[level]
    name += later
    name ^= name >> _SHIFT
    name *= _M[(level + 5) % 12]
    return name


def q_gram_buckets(data: np.ndarray) -> np.ndarray:
    names, width, level = _BYTE[data], 1, 0
    while width < Q:
        names = refine(names[:-width], names[width:], level)
        width, level = 2 * width, level + 1
    return names


def string_names(buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the strings of ``LENGTH`` bytes at ``starts``."""
    def double(at):
        return refine(buckets[at], buckets[at + Q], 6)

    return refine(double(starts), double(starts + (LENGTH - 2 * Q)), 7)


def core_names(buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Names of the ``LENGTH + 1 - BLOCK`` bytes at ``starts``, which the strings of a block of start positions share."""
    def double(at):
        return refine(buckets[at], buckets[at + Q], 6)

    return refine(double(starts), double(starts + (LENGTH + 1 - BLOCK - 2 * Q)), 10)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, context, first start, number of starts - 1, anchor - first start) of each anchor in texts laid end to end.

    ``ends`` are the ends of the texts in ``data``; no string goes over one.
    """
    assert len(data) < 1 << POSITION_BITS, "a buffer longer than its positions"
    buckets = q_gram_buckets(data)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    keys = buckets & ~mask
    keys |= mask - np.arange(len(keys), dtype=np.uint64)
    window, width = LENGTH - Q + 1, 1
    while 2 * width <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if window > width:
        keys = np.minimum(keys[: len(keys) - (window - width)], keys[window - width:])
    outside = np.zeros(len(keys) + LENGTH, bool)
    start = 0
    for end in ends.tolist():
        outside[max(start, end - LENGTH + 1): end] = True
        start = end
    outside = outside[: len(keys)]
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (outside[1:] != outside[:-1])) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(keys) - 1]))
    inside = ~outside[first]
    first, last = first[inside], last[inside]
    at = (mask - (keys[first] & mask)).astype(np.int64)
    span = (((last - first) << 8) | (at - first)).astype(np.uint64)
    context = refine(refine(string_names(buckets, first), string_names(buckets, last), 8), span, 9)
    return buckets[at], context, first, last - first, at - first


class Buffers:
    """Whole texts, or parts of long ones that overlap by ``LENGTH - 1`` bytes, in buffers of about ``BUFFER`` bytes."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: tuple, data: bytes) -> Iterator[None]:
        """Adds the text, and yields each time the buffer is full: it must be taken then, also between parts of one text."""
        for base in range(0, max(1, len(data) - LENGTH + 1), BUFFER):
            part = data[base: base + BUFFER + LENGTH - 1]
            if len(part) >= LENGTH:
                self.parts.append((key, base, part))
                self.size += len(part)
            if self.size >= BUFFER:
                yield

    def take(self) -> tuple[np.ndarray, np.ndarray, list[tuple], np.ndarray]:
        """Bytes laid end to end, the ends of the parts, their keys and their first bytes' places in the text."""
        parts, self.parts, self.size = self.parts, [], 0
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        return data, np.cumsum([len(p) for _, _, p in parts]), [k for k, _, _ in parts], np.asarray([b for _, b, _ in parts])


def repeated_in(order: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which rows are equal in ``same`` to a row that is smaller in ``order``; rows equal in both are the same string."""
    at = np.lexsort(order[::-1] + same[::-1])
    joins = np.ones(len(at), bool)
    equal = np.ones(len(at), bool)
    joins[:1] = equal[:1] = False
    for column in same:
        joins[1:] &= column[at][1:] == column[at][:-1]
    for column in order:
        equal[1:] &= column[at][1:] == column[at][:-1]
    # a row repeats its group's first unless all rows since stand at the same place
    group = np.cumsum(~joins)
    moved = joins & ~equal
    first_move = np.full(group[-1] + 1 if len(group) else 1, len(at))
    where = np.flatnonzero(moved)
    np.minimum.at(first_move, group[where], where)
    out = np.zeros(len(at), bool)
    out[at] = np.arange(len(at)) >= first_move[group] if len(group) else False
    return out


def merged_spans(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (text number, first byte, end) joined where they touch; the input need not be sorted."""
    at = np.lexsort((first, text))
    text, first, last = text[at], first[at], last[at]
    if not len(text):
        return text, first, last
    far = int(last.max()) + 1
    reach = np.maximum.accumulate(text * far + last)
    new = np.concatenate(([True], (text[1:] * far + first[1:]) > reach[:-1]))
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:] - 1, [len(text) - 1]))
    return text[starts], first[starts], reach[ends] - text[ends] * far
