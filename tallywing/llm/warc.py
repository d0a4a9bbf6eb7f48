"""WARC archives of pages: written, read back, and indexed by a merge of sorted runs.

Records go through Spark's text sink, which commits whole files, so a lost task leaves nothing behind and archives may
lie in any store Spark reaches. The WARC-Warcinfo-ID of the run, a random number, is the first header of every record:
with the version line before it, it is the separator by which archives are read, in splits, by as many tasks as their
size asks for, and no payload can hold it but by knowing it. Content-Length and digest are checked on reading.

The index is an external merge: entries are sorted run by run where they are read, each run is cut at the bounds of the
key ranges, and each range merges its k run segments with a loser tree by URL key and time. Bounds come from a sample
(``SAMPLED`` keys a range) and hold time and page too, so that one URL with a third of all captures is spread as well.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import frugal, settle
from tallywing.session import scratch_path

#: Payloads of fewer bytes are stored each time; entries of a key range and a run at most, and keys sampled a range.
LEAST_BYTES, RANGE_ROWS, RUN_ROWS, SAMPLED = 1000, 50_000, 100_000, 20

CRLF = "\r\n"
ENTRY = ("url_key string, captured timestamp, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, record_id string, archive string")
HISTORY = f"{ENTRY}, key_range int, position long"


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(page.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def _written(instant: Column) -> Column:
    """WARC-Date of an instant: UTC, whatever the session's time zone; no local time is made on the way."""
    seconds = F.unix_seconds(instant)
    day, rest = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(day.cast("string"), F.lit("T"), clock)


def write_archives(pages: DataFrame, path: str, run: str, captured: Column | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """One record per row of ``pages`` (page_id, url, html) under ``path``, and a warcinfo record of the run.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is a response (all
    that carry this id, if it repeats) and the others revisit it without storing the payload again; smaller ones are
    responses, and so are copies none of which has an id. A NULL html is an empty payload; a NULL url or id leaves its
    header out. ``captured`` is the capture time; pages carry none, so by default it is page_id seconds after 1970.
    """
    when = captured if captured is not None else F.timestamp_seconds(F.coalesce(F.pmod(F.col("page_id"), F.lit(1 << 31)), F.lit(0)))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest"), when.alias("captured"))
    copies = settle(
        rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("of"), F.col("bytes").alias("long"))
        .agg(F.count("*").alias("n"), F.max("page_id").alias("kept")).where("n > 1 and kept is not null").drop("n"), "warc-copies")
    typed = rows.join(copies, (F.col("digest") == F.col("of")) & (F.col("bytes") == F.col("long")), "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    stored = F.when(revisit, F.lit("")).otherwise(F.col("payload"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def optional(name: str, value: Column) -> Column:
        return F.coalesce(header(name, value), F.lit(""))

    start = F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{run}>{CRLF}")
    record = F.concat(
        start,
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        header("WARC-Date", _written(F.col("captured"))),
        optional("WARC-Target-URI", safe),
        optional("Page-ID", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(
            header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            header("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("kept"), F.col("digest")), F.lit(">"))),
            header("Refers-To-Page-ID", F.col("kept").cast("string")))).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(stored).cast("string")),
        F.lit(CRLF), stored)
    info = F.concat(start, header("WARC-Type", F.lit("warcinfo")), header("WARC-Record-ID", F.lit(f"<urn:uuid:{run}>")),
                    header("Content-Length", F.lit("0")), F.lit(CRLF))
    one = pages.sparkSession.range(1).select(info.alias("record"))
    typed.select(record.alias("record")).unionByName(one).write.option("lineSep", CRLF * 2).text(path)


def read_archives(spark, path: str, run: str) -> DataFrame:
    """(headers.., stored binary) of every response and revisit record under ``path``.

    A record that is cut short, or whose stored payload has another digest than it states, fails the job.
    """
    separator = f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{run}>{CRLF}"
    raw = spark.read.option("lineSep", separator).text(path).where(F.octet_length("value") > 0)
    head = F.substring_index("value", CRLF * 2, 1)
    body = F.col("value").cast("binary")

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
        return F.when(F.col("head").rlike(rf"(?:^|\r\n){name}: "), found)

    rows = raw.select(head.alias("head"), body.alias("body"), F.input_file_name().alias("archive")).where(
        ~F.col("head").rlike(r"(?:^|\r\n)WARC-Type: warcinfo"))
    length = field("Content-Length").cast("int")
    parsed = rows.select(
        field("WARC-Target-URI").alias("url"), F.try_to_timestamp(field("WARC-Date")).alias("captured"),
        field("Page-ID").cast("long").alias("page_id"), field("WARC-Type").alias("record_type"),
        field("Refers-To-Page-ID").cast("long").alias("refers_to"), field("WARC-Record-ID").alias("record_id"),
        field("Payload-Length").cast("long").alias("stated_bytes"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("stated_digest"),
        F.substring(F.col("body"), F.octet_length("head") + 5, length).alias("stored"), length.alias("length"),
        F.octet_length("body").alias("whole"), F.octet_length("head").alias("before"), "archive")
    whole = (F.col("whole") == F.col("before") + 4 + F.col("length") + 4)
    same = (F.col("record_type") == "revisit") | (F.sha1("stored") == F.col("stated_digest"))
    checked = F.when(whole & same, F.col("stated_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged WARC record "), F.coalesce("record_id", F.lit("?")))))
    return parsed.withColumn("payload_digest", checked).drop("stated_digest", "length", "whole", "before")


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed, then the rest in lower case without scheme, port and fragment; '' for NULL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1))
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


class LoserTree:
    """Merge of sorted iterators: each inner node keeps the loser of its match, so the next item costs one climb."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key = sources, key
        self.heads = [self._pull(i) for i in range(len(sources))]
        n = max(1, len(sources))
        self.losers, winners = [0] * n, [0] * n + list(range(len(sources)))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if len(sources) > 1 else 0

    def _pull(self, i: int):
        item = next(self.sources[i], None)
        return None if item is None else (self.key(item), i, item)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def __iter__(self):
        while self.sources and (head := self.heads[self.winner]) is not None:
            yield head[2]
            i = self.winner
            self.heads[i] = self._pull(i)
            node = (i + len(self.sources)) // 2
            while node:
                if self._before(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def _order(entry: tuple) -> tuple:
    """URL key as bytes, time, page (NULL first), record; rows equal in all of these by their place in the table."""
    return (entry[0].encode(), entry[1], entry[2] is not None, entry[2] or 0, entry[8], entry[-1])


def _rows(batch) -> Iterable[tuple]:
    columns = [c.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(c.type) else c.to_pylist() for c in batch.columns]
    return zip(*columns)


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
_NAMES = [part.split()[0] for part in ENTRY.split(", ")]
_PLACED = [*_TYPES, pa.int64()]
_ENTRIES = pa.schema(list(zip([*_NAMES, "place"], _PLACED)))


def merge_index(entries: DataFrame, range_rows: int = RANGE_ROWS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``entries`` in global order: (entry.., key_range, position), sorted by (url_key, captured, page_id, record_id).

    Repeated rows are kept; their place in the table parts them, so that a range stays bounded whatever repeats.
    """
    n = entries.count()
    placed = entries.select(*_NAMES, F.monotonically_increasing_id().alias("place"))
    ranges = max(1, -(-n // range_rows))
    bounds: list[tuple] = []
    if ranges > 1:
        share = max(1, n // (SAMPLED * ranges))
        sample = placed.where(F.pmod(F.xxhash64("record_id", "place"), F.lit(share)) == 0).select(
            "url_key", F.unix_micros("captured"), "page_id", "record_id", "place").collect()
        found = sorted((r[0].encode(), r[1], r[2] is not None, r[2] or 0, r[3], r[4]) for r in sample)
        bounds = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    segment = pa.schema([("key_range", pa.int32()), ("run", pa.int64()), ("rows", pa.binary())])

    def runs(batches):
        held, number, base = [], 0, TaskContext.get().partitionId() << 32

        def cut():
            held.sort(key=_order)
            parts: dict[int, list] = {}
            for row in held:
                parts.setdefault(bisect_right(bounds, _order(row)), []).append(row)
            out = []
            for at, rows in parts.items():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ENTRIES) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PLACED)], schema=_ENTRIES))
                out.append((at, base + number, sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), segment)], schema=segment)

        for batch in batches:
            for row in _rows(batch):
                held.append(row)
                if len(held) >= run_rows:
                    yield cut()
                    held, number = [], number + 1
        if held:
            yield cut()

    def merged(key, table):
        def rows_of(data: bytes):
            with pa.ipc.open_stream(data) as reader:
                for batch in reader:
                    yield from _rows(batch)

        tree = LoserTree([rows_of(data) for data in table.column("rows").to_pylist()], _order)
        rows = list(tree)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
        columns[1] = columns[1].cast(pa.timestamp("us", "UTC"))
        return pa.table([*columns, pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int64())],
                        names=[*_NAMES, "key_range", "position"])

    segments = placed.mapInArrow(frugal(runs), "key_range int, run long, rows binary")
    return segments.groupBy("key_range").applyInArrow(merged, HISTORY)


def archive(pages: DataFrame, path: str | None = None, captured: Column | None = None) -> DataFrame:
    """Write ``pages`` as WARC under ``path`` (a new folder of the shared scratch if None), read the archives back and
    return their capture histories (``HISTORY``) in global order of (key_range, position).

    Nulls, empty payloads and copies are treated as ``write_archives`` says; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path, run = path or scratch_path(spark, "warc"), str(uuid.uuid4())
    write_archives(pages, path, run, captured)
    records = read_archives(spark, path, run)
    size = F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.octet_length("stored").cast("long"))
    entries = settle(records.select(
        url_key(F.col("url")).alias("url_key"), "captured", "page_id", "url", "record_type", "refers_to", size.alias("payload_bytes"),
        "payload_digest", "record_id", "archive"), "warc-entries")
    return merge_index(entries)
