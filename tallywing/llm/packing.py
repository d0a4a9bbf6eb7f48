"""Packing documents into training sequences: bounded-space online best fit.

Each partition reads its documents once, in order. A document's ids are cut at the sequence length; whole pieces are
sequences of their own, and the rest goes to the open window it fits best. A partition keeps at most ``open_windows``
windows; where a rest fits none, the fullest is emitted (padded) and a new one is opened. What is open at the end is
merged: inside the partition the open windows are laid end to end and cut at the length, and the last incomplete
stretch of each partition, under one sequence, is merged with those of ``MERGED`` partitions; of that, what does not
fill a sequence is cut into lengths that are powers of two, which need no padding. No text or id is shuffled but those
last stretches, and a task holds one batch of documents and its open windows.
"""

from __future__ import annotations

import json
import re
import string
import struct
import unicodedata
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import frugal, worker_keeps
from tallywing.session import scratch_path

LENGTH, OPEN_WINDOWS, END_ID = 2048, 64, 1
#: Partitions whose last stretches are merged together, and rows of bytes a task holds before it hands them on.
MERGED, FLUSH_BYTES = 256, 8 << 20
#: Words whose ids a worker remembers, in two halves: when the younger is full, it becomes the older, which goes.
REMEMBERED = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
_ARROW = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in _COLUMNS])


def printable_bytes() -> str:
    """The character by which a byte-level vocabulary shows each of the 256 bytes: printable ones as they are, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    beyond = count(0x100)
    return "".join(chr(b if b in plain else next(beyond)) for b in range(256))


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and case, and normalises and splits inside words only, so the ids of a text are
    those of its words one after the other. A word of letters with marks around it has the ids of its parts;
    apostrophes, which the vocabulary joins to letters, and special tokens, which begin with ``<|``, are left to the
    tokenizer, and so are texts whose case or marks might behave otherwise alone, texts that are not in NFC, and all texts
    where the vocabulary has other rules than these.
    """

    marks = "".join(sorted(set(string.punctuation) - set("'<")))
    odd = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\u03a3")  # special tokens; what Python alone splits at; a letter with two lower cases
    runs = re.compile(r"[.,](?<=[^\w\s][.,]|_[.,])\s")  # marks that stand together are one part
    #: Fixed: the vocabulary's rules for white space, case and parts of words, for which words may be taken one by one.
    normalizer = {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    splits = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Letters below this one are letters to every version of Unicode.
    beyond = "\u0250"
    shown = printable_bytes()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}  # the words before these; one that is met again stays
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        parts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_words = rules["normalizer"] == self.normalizer and [p["type"] for p in parts] == ["Split", "ByteLevel"] and (
            parts[0]["pattern"] == {"Regex": self.splits} and not parts[1]["add_prefix_space"])

    def encode(self, words: list[str]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self[word] = np.asarray(e.ids, dtype="<u4").tobytes()

    def encode_letters(self, words: list[str]) -> None:
        """Words that are one part each, which no rule changes any more: the vocabulary's model takes their bytes."""
        pieces = self.tokenizer.model.tokenize
        for word in words:
            shown = word if word.isascii() else charmap_decode(word.encode(), "strict", self.shown)[0]
            ids = [piece.id for piece in pieces(shown)]
            self[word] = struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        letters, split, others = [], [], set()
        for word in words:
            if word.isalpha():
                if word.isascii() or max(word) < self.beyond:
                    letters.append(word)
                else:
                    others.add(word)
                continue
            core = word.strip(self.marks)
            if core.isalpha():
                at = word.index(core)
                parts = word[:at], core, word[at + len(core):]
                split.append((word, parts))
                others.update(parts)
            else:
                others.add(word)
        self.encode_letters(letters)
        others = {w for w in others if w not in self}
        parts = [w for w in others if w.isalpha() and (w.isascii() or max(w) < self.beyond)]
        self.encode_letters(parts)
        self.encode(list(others.difference(parts)))
        for word, parts in split:
            self[word] = b"".join(map(self.__getitem__, parts))

    def lowered(self, text: str) -> str | None:
        """The text in lower case; None where it is left to the tokenizer."""
        if not self.by_words or any(mark in text for mark in self.odd) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower()

    def of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those not met before are learned."""
        found = list(map(self.get, words))
        at = [k for k, ids in enumerate(found) if ids is None]
        if at:
            older = self.older
            if 2 * (len(self) + len(at)) > REMEMBERED:
                self.older = dict(self)
                self.clear()
            unseen = []
            for k in at:
                ids = found[k] = older.get(words[k])
                if ids is None:
                    unseen.append(words[k])
                else:
                    self[words[k]] = ids
            self.learn(unseen)
            for k in at:
                if found[k] is None:
                    found[k] = self[words[k]]
        return found

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in lower case: the distinct words are looked up, and their ids gathered in the order of the words."""
        rows = pa.array(texts, pa.large_string())
        spaced = rows
        for mark in (". ", ", ", ".\n"):
            spaced = pc.replace_substring(spaced, mark, f" {mark}")
        together = pa.array([self.runs.search(text) is not None for text in texts])
        lists = pc.utf8_split_whitespace(pc.if_else(together, rows, spaced))
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self.of_words(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        if not len(ids):
            return [b""] * len(texts)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[lists.offsets.to_numpy()].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]

    def texts(self, texts: list[str]) -> list[bytes]:
        plain = [self.lowered(t) for t in texts]
        joined = iter(self.joined([t for t in plain if t is not None]))
        whole = [t for t, low in zip(texts, plain) if low is None]
        got = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
        return [np.asarray(next(got).ids, dtype="<u4").tobytes() if low is None else next(joined) for low in plain]


def word_ids(path: str) -> WordIds:
    """The worker's own table of word ids."""
    return worker_keeps(("word_ids", path), lambda: WordIds(path))


class Out:
    """Rows handed on as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        columns = list(zip(*rows)) if rows else [()] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def documents_in(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[list[tuple[int | None, str]]]:
    """(doc_id, text) in groups of about ``most`` characters; a NULL text is empty."""
    group, held = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            group.append((ids[i].as_py(), text))
            held += len(text)
            if held >= most:
                yield group
                group, held = [], 0
    if group:
        yield group


def lay(pieces: list[tuple], length: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Pieces (doc_id, start, ids, doc_tokens) end to end, cut at ``length``: the full windows, and what is left."""
    full, window, free = [], [], length
    for doc, start, ids, total in pieces:
        while len(ids) // 4 >= free:
            window.append((doc, start, ids[: 4 * free], total))
            full.append(window)
            start, ids, window, free = start + free, ids[4 * free:], [], length
        if ids:
            window.append((doc, start, ids, total))
            free -= len(ids) // 4
    return full, window


def best_fit(groups, length: int, most: int):
    """Windows (lists of pieces) as they close, then what is open at the end."""
    spaces: list[tuple[int, int]] = []  # (free ids, window number), sorted
    windows: dict[int, list[tuple]] = {}
    number = 0
    for doc, ids in groups:
        total = len(ids) // 4
        for start in range(0, total - total % length, length):
            yield [(doc, start, ids[4 * start: 4 * (start + length)], total)]
        rest = total % length
        if not rest:
            continue
        piece = (doc, total - rest, ids[4 * (total - rest):], total)
        at = bisect_left(spaces, (rest, -1))
        if at < len(spaces):
            free, k = spaces.pop(at)
        else:
            if len(spaces) == most:
                yield windows.pop(spaces.pop(0)[1])
            free, k, number = length, number, number + 1
            windows[k] = []
        windows[k].append(piece)
        if free == rest:
            yield windows.pop(k)
        else:
            insort(spaces, (free - rest, k))
    return [windows[k] for _, k in spaces]


def _write(out: Out, window: list[tuple], sequence: int | None) -> None:
    offset = 0
    for doc, start, ids, total in window:
        n = len(ids) // 4
        out.add((doc, start, n, ids, total, sequence, offset), len(ids))
        offset += n


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row a piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers; the ids of a document are its text's by the
    vocabulary at ``tokenizer``, then ``end_id``. A NULL or empty text is the end id alone. Each id lies in one piece.
    Repeated rows are packed each on its own; an empty table gives no rows. ``length`` must be a power of two.
    """
    end = np.uint32(end_id).astype("<u4").tobytes()

    def pack_partition(batches):
        table, out = word_ids(tokenizer), Out(_ARROW)
        base, number = TaskContext.get().partitionId() << 32, 0

        def encoded():
            for group in documents_in(batches):
                yield from zip((doc for doc, _ in group), (ids + end for ids in table.texts([text for _, text in group])))

        closing = best_fit(encoded(), length, open_windows)
        while True:
            try:
                window = next(closing)
            except StopIteration as stop:
                open_at_end = stop.value
                break
            _write(out, window, base + number)
            number += 1
            if out.full():
                yield out.batch()
        full, rest = lay([piece for window in open_at_end for piece in window], length)
        for window in full:
            _write(out, window, base + number)
            number += 1
        _write(out, rest, None)
        yield out.batch()

    def merge(key, table):
        out, base, number = Out(_ARROW), (1 << 62) + (key[0].as_py() << 32), 0
        rows = sorted((tuple(r[c] for c in ("part", "offset", "doc_id", "start", "ids", "doc_tokens")) for r in table.to_pylist()),
                      key=lambda r: r[:2])
        full, rest = lay([r[2:] for r in rows], length)
        left = sum(len(ids) // 4 for _, _, ids, _ in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            first, rest = lay(rest, size)
            full, rest, left = [*full, first[0]], [p for w in first[1:] for p in w] + rest, left - size
        for window in full:
            _write(out, window, base + number)
            number += 1
        return pa.Table.from_batches([out.batch()])

    spark = docs.sparkSession
    path = scratch_path(spark, "pack")
    first = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(pack_partition), SCHEMA)
    first.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    packed = spark.read.schema(f"{SCHEMA}, part int").parquet(path)
    open_rows = packed.where("sequence_id is null").withColumn("together", F.floor(F.col("part") / MERGED))
    merged = open_rows.groupBy("together").applyInArrow(merge, SCHEMA)
    return packed.where("sequence_id is not null").select(*_COLUMNS).unionByName(merged)
