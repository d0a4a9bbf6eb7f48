"""Fill-in-the-middle against a plain version on Python strings, and the exact way back."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import fim
from tallywing.llm.codepoints import Exceptions

ALPHABET = "ab<>PSM \n" + "éßЖ中€𝄞😀́"


def brute(doc, text, changed=90, suffix_first=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= changed:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_the_index_counts_bytes_and_code_points():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(60)))
        index = Exceptions(np.frombuffer(text.encode(), np.uint8))
        at = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
        assert (index.bytes(np.arange(len(text) + 1)) == at).all() and (index.points(at) == np.arange(len(text) + 1)).all()


def test_against_strings(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randrange(40)))) for i in range(3000)]
    rows += [(3000, "x<P>"), (3001, "<S"), (3002, "x" * 300_000 + "é" * 300_000), (3003, None), (None, "no id at all"), (7, rows[7][1]), (3004, "<" + "P>"[::-1])]
    monkeypatch.setattr(fim.text_slices, "__defaults__", (1000,))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    got = fim.restore(fim.transform(docs)).collect()
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(
        repr((i, *brute(i, t))) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.restored) for r in got)
    assert back == sorted((-1 if i is None else i, t or "") for i, t in rows)


@pytest.mark.parametrize("changed, suffix_first, forms", [(0, 50, {"plain"}), (100, 100, {"plain", "spm"}), (100, 0, {"plain", "psm"})])
def test_shares(spark, odd, changed, suffix_first, forms):
    got = fim.transform(odd, changed, suffix_first).collect()
    assert len(got) == odd.count() and {r.form for r in got} == forms


def test_no_rows(none):
    assert fim.restore(fim.transform(none)).where(F.col("n") >= 0).isEmpty()
