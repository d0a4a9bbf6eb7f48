"""Secrets in texts, found by one automaton of all rules in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.automaton import Automaton, Rule
from tallywing.llm.codepoints import Exceptions, text_slices
from tallywing.llm.common import frugal

#: Fixed: the base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: More kinds: tokens of code hosts, signed web tokens and private keys, by the forms their makers publish.
MORE = (
    Rule("host", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 10),
    Rule("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
)
RULES = BASE + MORE

SCHEMA = "doc_id long, spans array<struct<kind string, start long, end long>>"


def with_ends(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a byte 0 behind each, and where each begins then."""
    texts = len(ends) - 1
    return np.insert(data, ends[1:], 0), ends + np.arange(texts + 1)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``; a span is (kind, start, end), end exclusive, in code points, by start and then
    in the order of ``rules``.

    The automaton is made once; its size follows the rules, not the texts. A NULL or empty text has no spans, repeated
    rows have the same ones, an empty table gives no rows. A byte 0 in a text ends a match, as it is in no rule. Other
    columns are not read.
    """
    automaton = Automaton(rules)
    kinds = np.array([r.kind for r in rules])
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches):
        for batch in batches:
            for part, data, ends in text_slices(batch, 1):
                data, begin = with_ends(data, ends)
                rule, start, end = automaton.matches(data)
                text = np.searchsorted(begin, start, "right") - 1
                order = np.lexsort((rule, start, text))
                rule, start, end, text = rule[order], start[order], end[order], text[order]
                index = Exceptions(data)
                first = index.points(begin)[text]
                found = pa.StructArray.from_arrays(
                    [pa.array(kinds[rule], pa.string()), pa.array(index.points(start) - first), pa.array(index.points(end) - first)], fields=list(span))
                upto = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=part.num_rows)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(upto), found)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(frugal(rows), SCHEMA)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from ``scan``; the digest is over the spans of the base kinds."""
    kinds = [r.kind for r in BASE]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(written(of(*kinds)).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
