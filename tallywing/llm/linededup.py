"""Line dedup by winnowing over line hashes.

A text is its lines that hold a word. From each such line the shortest run of lines with at least ``LEAST_WORDS`` words is
a window; the smallest line hash in it is its fingerprint, so any repeated run with that many words
shares a fingerprint. Positions of fingerprints found once in the corpus are dropped; around the others matches are
extended both ways over the windows they stand for, compared by name (a hash of the whole window). A window that stands
earlier in the corpus too is a repeat and its lines go; windows that follow each other make up the repeated run.

A run's last lines may hold too few words for a window that starts there. With ``both_ways`` the shortest run with enough
words that ends at a line is a window too, so a repeated run is extended to its last line: a line goes if any run of lines
with ``LEAST_WORDS`` words that covers it stands earlier. (Either a window starts at the line and lies in the run, or that
which ends at the run's last line covers it.)

Copies inside a task's buffer are settled there, so a line or passage in a third of all texts sends one row a buffer on,
and no step pairs positions with each other.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywing.llm.common import WORD, free_names, frugal, settle

LEAST_WORDS, BUFFER_CHARS, NO_ID = 10, 1 << 20, -(1 << 63)

_FOUND = "fingerprint long, doc long, tag string, windows array<struct<name long, first int, last int>>, spans array<struct<first int, last int>>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def windows_of(lines: list[str], words: list[int], least: int, both_ways: bool = False) -> list[tuple[int, int, int, int]]:
    """(fingerprint, name, first line, last line) of each window, lines numbered as given."""
    hashes, places, end, held = [_hash(line) for line in lines], [], 0, 0
    for first in range(len(lines)):
        while end < len(lines) and held < least:
            held += words[end]
            end += 1
        if held < least:
            break
        places.append((first, end))
        held -= words[first]
    if both_ways:
        forward, first, held = set(places), 0, 0
        for end in range(1, len(lines) + 1):
            held += words[end - 1]
            while held - words[first] >= least:
                held -= words[first]
                first += 1
            if held >= least and (first, end) not in forward:
                places.append((first, end))
    return [(min(hashes[a:b]), _hash("\n".join(lines[a:b])), a, b - 1) for a, b in places]


def worded(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """The lines that hold a word, their numbers of words, and their places among all lines."""
    lines = (text or "").split("\n")
    counts = [len(re.findall(WORD, line)) for line in lines]
    at = [i for i, n in enumerate(counts) if n]
    return [lines[i] for i in at], [counts[i] for i in at], at


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, both_ways: bool = False) -> tuple[DataFrame, Column]:
    """(doc, tag, runs) of each text with repeated lines: ``runs`` are (first, last) of lines that hold a word, which may
    overlap; and the expression of tag, which tells texts of one repeated id apart (their md5; empty where no id repeats)."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    tagged = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    window = pa.struct([("name", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(window), pa.list_(span)]
    names = ["fingerprint", "doc", "tag", "windows", "spans"]

    def settled(held):
        """Rows of a buffer: (doc, tag, windows) to one row per fingerprint and text, repeats inside the buffer as spans."""
        first: dict[tuple[int, int], tuple[int, str, int]] = {}
        for doc, tag, windows in held:
            for fingerprint, name, a, _ in windows:
                at = (doc, tag, a)
                if first.setdefault((fingerprint, name), at) > at:
                    first[(fingerprint, name)] = at
        out = []
        for doc, tag, windows in held:
            kept, gone = {}, []
            for fingerprint, name, a, b in windows:
                if first[(fingerprint, name)] == (doc, tag, a):
                    kept.setdefault(fingerprint, []).append({"name": name, "first": a, "last": b})
                else:
                    gone.append({"first": a, "last": b})
            out += [(fingerprint, doc, tag, found, None) for fingerprint, found in kept.items()]
            if gone:
                out.append((None, doc, tag, None, gone))
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                lines, counts, _ = worded(text)
                tag = hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest() if tagged else ""
                held.append((doc, tag, windows_of(lines, counts, least_words, both_ways)))
                size += len(text or "")
                if size >= BUFFER_CHARS:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)

    found = settle(ids.mapInArrow(frugal(rows), _FOUND), "lines-windows")
    positions = found.where("fingerprint is not null").select("fingerprint", "doc", "tag", "windows")
    repeated = settle(positions.groupBy(F.col("fingerprint").alias("again")).count().where("count > 1").select("again"), "lines-fingerprints")
    met = positions.join(repeated, F.col("fingerprint") == F.col("again")).select("fingerprint", "doc", "tag", F.explode("windows").alias("w"))
    place = F.rank().over(Window.partitionBy("fingerprint", "name").orderBy("doc", "tag", "first"))
    later = met.select("fingerprint", "w.name", "doc", "tag", "w.first", "w.last").withColumn("place", place).where("place > 1")
    spans = later.select("doc", "tag", "first", "last").unionByName(
        found.where("fingerprint is null").select("doc", "tag", F.explode("spans").alias("s")).select("doc", "tag", "s.first", "s.last"))
    runs = spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return runs, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if tagged else F.lit("")


def without(text: str | None, runs) -> tuple[str | None, int, int, int, int | None]:
    """The text without the lines of ``runs``, its worded lines, those removed, the words kept, and the first line removed.

    A line without a word goes if its neighbours that hold words, or the text's ends, are gone on both sides and one is.
    """
    lines, counts, at = worded(text)
    gone = {k for a, b in runs or () for k in range(a, b + 1)}
    if not gone:
        return text, len(lines), 0, sum(counts), None
    every = text.split("\n")
    drop = {at[k] for k in gone}
    edges = [-1, *at, len(every)]
    for k in range(len(edges) - 1):
        left, right = k == 0 or k - 1 in gone, k == len(at) or k in gone
        if left and right:
            drop.update(range(edges[k] + 1, edges[k + 1]))
    kept = "\n".join(line for i, line in enumerate(every) if i not in drop)
    return kept, len(lines), len(gone), sum(n for k, n in enumerate(counts) if k not in gone), min(gone)


def remove_lines(docs: DataFrame, least_words: int = LEAST_WORDS, both_ways: bool = False) -> DataFrame:
    """``docs``, all columns, with ``text`` without later repeated runs of lines, and (n_lines, n_removed, kept_words,
    first_removed) under those names or, where ``docs`` has them, under the names with underscores before.

    Earlier is by doc_id, then line; a NULL id is before all others. Rows with equal id and text are one document and get
    the same result; of different texts with one id that with the smaller md5 is first. A NULL text stays NULL. Runs
    with fewer than ``least_words`` words stay, however often they stand. With ``both_ways`` each repeated run goes to its last
    line; without, its last lines stay where together they hold fewer than ``least_words`` words. An empty table gives no rows.
    """
    runs, tag = find_runs(docs.select("doc_id", "text"), least_words, both_ways)
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"))
    joined = rows.join(runs, ["doc", "tag"], "left")
    counts = "struct<text: string, n_lines: long, n_removed: long, kept_words: long, first_removed: long>"

    @F.pandas_udf(counts)
    def cut(texts, spans):
        import pandas as pd

        out = [without(t, [(s["first"], s["last"]) for s in found] if found is not None else None) for t, found in zip(texts, spans)]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "kept_words", "first_removed"]).astype({"first_removed": "Int64"})

    wanted = ["n_lines", "n_removed", "kept_words", "first_removed"]
    done = joined.select("row", cut("row.text", "runs").alias("cut"))
    return done.select(
        *[F.col("cut.text").alias("text") if c.lower() == "text" else F.col(f"row.`{c}`") for c in docs.columns],
        *[F.col(f"cut.{c}").alias(n) for c, n in zip(wanted, free_names(docs.columns, *wanted))])
