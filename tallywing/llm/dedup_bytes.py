"""The Spark job over ``repeats``: two shuffles of sampled suffixes, then the texts once more with what to remove."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywing.llm.common import frugal, settle
from tallywing.llm.repeats import BLOCK, LENGTH, Buffers, anchors, core_names, merged_spans, q_gram_buckets, repeated_in, string_names

#: A bucket with this many contexts in one buffer is known to need its strings named; two of them tell the other tasks.
CROWDED = 4

#: Kinds of rows: an anchor to compare, an anchor whose strings must be named, a span to remove (``other`` is its end).
ANCHOR, NAME, SPAN = 0, 1, 2
_SCHEMA = "bucket long, other long, doc long, tag long, start long, more int, lead int, kind int"
_ARROW = pa.schema([(c, pa.int64()) for c in ("bucket", "other", "doc", "tag", "start")] + [(c, pa.int32()) for c in ("more", "lead", "kind")])

#: Strings of one block of an anchor (``names``) by the name of the bytes they share, or a span to remove (``last`` is its end).
_NAMED = "core long, doc long, tag long, start long, last long, names array<long>"
_NAMED_ARROW = pa.schema([(c, pa.int64()) for c in ("core", "doc", "tag", "start", "last")] + [("names", pa.list_(pa.int64()))])

#: Stands for a NULL doc_id, which is before all others.
NO_ID = -(1 << 63)


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _signed(names: np.ndarray) -> np.ndarray:
    return names.view(np.int64)


def _spans(docs, tags, text, first, last):
    """Rows of spans of the texts numbered ``text``."""
    text, first, last = merged_spans(text, first, last)
    spread = (docs[text] * 1_000_003) ^ first
    return _batch(spread, last, docs[text], tags[text], first, *np.zeros((2, len(text)), np.int32), np.full(len(text), SPAN, np.int32))


def _located(buffer):
    data, ends, keys, bases = buffer.take()
    docs, tags = (np.asarray([k[i] for k in keys], np.int64) for i in (0, 1))
    starts = np.concatenate(([0], ends[:-1]))
    return data, ends, docs, tags, bases, starts


def compare_anchors(buffer: Buffers):
    data, ends, docs, tags, bases, starts = _located(buffer)
    bucket, context, first, more, lead = anchors(data, ends)
    part = np.searchsorted(ends, first, side="right")
    at = first - starts[part] + bases[part]
    copy = repeated_in((docs[part], tags[part], at), (bucket, context))
    yield _spans(docs, tags, part[copy], at[copy], (at + more + LENGTH)[copy])
    keep = np.flatnonzero(~copy)
    pairs = np.unique(np.stack([bucket[keep], context[keep]]), axis=1) if len(keep) else np.zeros((2, 0), np.uint64)
    crowded, many = np.unique(pairs[0], return_counts=True)
    crowded = crowded[many >= CROWDED]
    known = np.isin(bucket[keep], crowded)
    order = keep[known][np.argsort(bucket[keep[known]], kind="stable")]
    b, c = bucket[order], context[order]
    new = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0)) if len(b) else np.zeros(0, int)
    second = np.zeros(len(b), bool)  # the first row of a bucket with another context than its first row's
    other = np.flatnonzero(c != c[head]) if len(b) else np.zeros(0, int)
    if len(other):
        second[other[np.unique(head[other], return_index=True)[1]]] = True
    tell = order[new | second]
    send = np.concatenate([keep[~known], tell])
    for rows, kind in ((send, ANCHOR), (order, NAME)):
        p = part[rows]
        spread = bucket[rows] if kind == ANCHOR else context[rows]
        other_column = context[rows] if kind == ANCHOR else bucket[rows]
        yield _batch(_signed(spread), _signed(other_column), docs[p], tags[p], at[rows], more[rows].astype(np.int32),
                     lead[rows].astype(np.int32), np.full(len(rows), kind, np.int32))


def name_strings(buffer: list[tuple]):
    """Rows of ``_NAMED`` for the strings asked for; ``buffer`` has (doc, tag, bytes, asked), ``asked`` (start, more, lead)."""
    stretches = [(d, t, s, more, lead, data[s: s + more + LENGTH]) for d, t, data, asked in buffer for s, more, lead in asked]
    if not stretches:
        return
    # laid end to end: the names of a stretch of text alone are those it has in the whole
    count = np.asarray([r[3] + 1 for r in stretches])
    each = np.repeat(np.arange(len(stretches)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    base = np.concatenate(([0], np.cumsum(count + LENGTH - 1)))[:-1]
    buckets = q_gram_buckets(np.frombuffer(b"".join(r[5] for r in stretches), np.uint8))
    name = string_names(buckets, base[each] + step)
    doc, tag, first, lead = (np.asarray([r[i] for r in stretches], np.int64) for i in (0, 1, 2, 4))
    before = lead[each] - step  # bytes of the string before its anchor
    block = before // BLOCK
    new = np.concatenate(([True], (each[1:] != each[:-1]) | (block[1:] != block[:-1])))
    at = np.flatnonzero(new)
    core = core_names(buckets, base[each[at]] + lead[each[at]] - BLOCK * block[at])
    number = np.cumsum(new) - 1
    doc, tag, start = doc[each], tag[each], first[each] + step
    copy = repeated_in((doc, tag, start), (name, core[number]))
    pairs, text = np.unique(np.stack([doc[copy], tag[copy]]), axis=1, return_inverse=True)
    text, a, b = merged_spans(text.ravel(), start[copy], start[copy] + LENGTH)
    nothing = pa.nulls(len(text), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array((pairs[0][text] * 1_000_003) ^ a), pa.array(pairs[0][text]), pa.array(pairs[1][text]), pa.array(a),
                                      pa.array(b), nothing], schema=_NAMED_ARROW)
    kept = np.zeros(len(at), bool)
    kept[number[~copy]] = True
    mine = kept[number]
    sizes = np.diff(np.append(at, len(name)))[kept]
    names = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(_signed(name[mine])))
    rows = at[kept]
    yield pa.RecordBatch.from_arrays([pa.array(_signed(core[kept])), pa.array(doc[rows]), pa.array(tag[rows]), pa.array(start[rows]),
                                      pa.nulls(len(rows), pa.int64()), names], schema=_NAMED_ARROW)


def _place(*same: str) -> Column:
    """Place of a string among those of equal names, by text and start."""
    return F.rank().over(Window.partitionBy(*same).orderBy("doc", "tag", "start"))


def _tag(data: Column) -> Column:
    """The first 64 bits of the md5 as a signed number, as many as the names of strings have."""
    return F.conv(F.substring(F.md5(data), 1, 16), 16, -10).cast("long")


def repeated_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Column]:
    """(doc, tag, first, last) of spans to remove, which may overlap, and the expression of tag.

    ``doc`` is doc_id, the smallest long for NULL. ``tag`` tells apart texts of one repeated id (64 bits of their md5) and is 0
    where no id repeats; rows with equal id and text are one document.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    tagged = not ids.groupBy("doc").count().where("count > 1").isEmpty()

    def tag_of(data: bytes) -> int:
        return int.from_bytes(hashlib.md5(data).digest()[:8], "big", signed=True) if tagged else 0

    def find(batches):
        held = Buffers()
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                for _ in held.add((batch.column(0)[i].as_py(), tag_of(data)), data):
                    yield from compare_anchors(held)
        if held.parts:
            yield from compare_anchors(held)

    found = ids.mapInArrow(frugal(find), _SCHEMA).repartition("bucket").withColumn("place", _place("bucket", "other"))
    bucket = Window.partitionBy("bucket")
    found = found.withColumns({
        "low": F.min(F.when(F.col("kind") == ANCHOR, F.col("other"))).over(bucket), "high": F.max(F.when(F.col("kind") == ANCHOR, F.col("other"))).over(bucket)})
    anchor = F.col("kind") == ANCHOR
    found = found.select(
        "doc", "tag", "start", "more", "lead",
        F.when(anchor, F.col("start") + F.col("more") + LENGTH).otherwise(F.col("other")).alias("last"),
        F.when(F.col("kind") == NAME, F.lit(True)).when(anchor & (F.col("place") == 1) & (F.col("low") != F.col("high")), F.lit(True))
        .when((F.col("kind") == SPAN) | (anchor & (F.col("place") > 1)), F.lit(False)).alias("name")).where("name is not null")
    compared = settle(found, "repeats-anchors")

    asked = compared.where("name").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "more", "lead")).alias("asked"))
    tag = _tag(F.col("data")) if tagged else F.lit(0).cast("long")
    texts = ids.withColumn("tag", tag).join(asked, ["doc", "tag"]).select("doc", "tag", "data", "asked")

    def name(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                asked_of = [(a["start"], a["more"], a["lead"]) for a in batch.column(3)[i].as_py()]
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), asked_of))
                size += sum(LENGTH + a[1] for a in asked_of)
                if size >= 1 << 19:
                    yield from name_strings(held)
                    held, size = [], 0
        if held:
            yield from name_strings(held)

    # blocks whose shared bytes stand once in the corpus hold no repeat; the strings of the others are told apart by name
    named = texts.mapInArrow(frugal(name), _NAMED).repartition("core").withColumn("n", F.count("names").over(Window.partitionBy("core")))
    strings = named.where("names is null or n > 1").select("core", "doc", "tag", "start", "last", F.posexplode_outer("names").alias("i", "string"))
    strings = strings.withColumn("start", F.col("start") + F.coalesce("i", F.lit(0))).withColumn("place", _place("core", "string"))
    named = settle(strings.where("string is null or place > 1").select(
        "doc", "tag", F.col("start").alias("first"), F.coalesce("last", F.col("start") + LENGTH).alias("last")), "repeats-strings")
    spans = compared.where("not name").select("doc", "tag", F.col("start").alias("first"), "last").unionByName(named)
    return spans, _tag(F.coalesce(F.col(text), F.lit("")).cast("binary")) if tagged else F.lit(0).cast("long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, data, kept, n_removed, n_spans): each text as UTF-8 bytes, and without the bytes that repeat earlier ones.

    A NULL or empty text has no bytes. Rows with equal id and text are one document and get the same result; a NULL id is
    before all others, and of different texts with one id that with the smaller tag is first. Texts of fewer than
    ``LENGTH`` bytes keep all. An empty table gives no rows.
    """
    spans, tag = repeated_spans(docs.select("doc_id", "text"))
    per_text = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    joined = rows.join(per_text, ["doc", "tag"], "left").select(F.col("doc_id").cast("long"), "data", "spans")

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                kept, removed, runs = [], [], []
                for i in range(part.num_rows):
                    data, spans = part.column(1)[i].as_py(), part.column(2)[i].as_py()
                    if not spans:
                        kept.append(data), removed.append(0), runs.append(0)
                        continue
                    _, first, last = merged_spans(np.zeros(len(spans), np.int64), np.asarray([s["first"] for s in spans]),
                                                  np.asarray([s["last"] for s in spans]))
                    pieces, at = [], 0
                    for x, y in zip(first.tolist(), last.tolist()):
                        pieces.append(data[at:x])
                        at = y
                    kept.append(b"".join(pieces) + data[at:])
                    removed.append(int((last - first).sum()))
                    runs.append(len(first))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()),
                                                  pa.array(runs, pa.int64())], names=["doc_id", "data", "kept", "n_removed", "n_spans"])

    return joined.mapInArrow(frugal(cut), "doc_id long, data binary, kept binary, n_removed long, n_spans long")
