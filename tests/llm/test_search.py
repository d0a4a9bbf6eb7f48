"""Nearest neighbours, WARC and licences."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import ann, licence, warc
from tallywing.session import scratch_path


def nearest(rows, k, every):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            found = sorted(((-float(np.dot(a, b)), c) for c, b in ok if c != q and len(b) == len(a)))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_search_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "MOST_ROWS", block)
    monkeypatch.setattr(ann, "CELL_BLOCKS", 3)
    monkeypatch.setattr(ann, "QUERY_BLOCKS", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)]  # many ties
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [1e-3, 2.0, 3.0]), (420, [2.0, 2.0, 2.0]),
             (405, []), (None, [1.0] * 6), (406, [1e200] * 6), (407, [1e-310] + [0.0] * 5)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0).collect()))
    want = nearest(rows, 20, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_search_of_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (0, [3.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(frame, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 1, 1, 6.0), (0, 2, 1, 2.0), (0, 2, 1, 6.0)]  # a list for each row of the query's id
    assert ann.search(frame.where("vec_id > 5"), F.col("vec_id") == 0).isEmpty()


PAGE = "<html>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>"
PAGES = [(1, "http://www.B.org/x?q=1#f", PAGE), (2, "http://www.b.org/x?q=1", PAGE), (3, None, None), (4, "", ""), (5, "ftp://a.b.org:99/y", "small"),
         (6, "http://c.d/\r\nHost: e", "small"), (None, "http://a.org", PAGE), (None, "http://a.org", "t" * 2000), (7, "x", PAGE), (7, "x", PAGE)]


@pytest.mark.parametrize("split", ["128m", "200"])
def test_archive_round_trip(spark, split):
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.archive(pages).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(PAGES)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    n = len(PAGE.encode())
    assert by[1] == by[2] == [("revisit", 7, n)] and by[7] == [("response", None, n)] * 2
    assert sorted(by[None]) == [("response", None, 2000), ("revisit", 7, n)]
    assert by[3] == by[4] == [("response", None, 0)] and by[5] == by[6] == [("response", None, 5)]
    order = [(r["url_key"].encode(), r["captured"], r["page_id"] or -1) for r in sorted(rows, key=lambda r: (r["key_range"], r["position"]))]
    assert order == sorted(order)
    assert {r["url"] for r in rows if r["page_id"] in (3, 4)} == {None, ""}


def test_dates_are_utc_in_any_session(spark):
    """Two captures an hour apart, at one local time: the night when clocks go back."""
    pages = spark.createDataFrame([(1, "http://a.org", "one"), (2, "http://a.org", "two"), (3, "http://a.org", "old")], "page_id long, url string, html string")
    when = F.timestamp_seconds(F.when(F.col("page_id") == 1, 1636263000).when(F.col("page_id") == 2, 1636266600).otherwise(-1))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = warc.archive(pages, captured=when).select("page_id", F.unix_seconds("captured").alias("at"), "position").orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r["page_id"], r["at"]) for r in rows] == [(3, -1), (1, 1636263000), (2, 1636266600)]


def test_index_in_many_ranges_and_runs(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.org/").otherwise(
        F.concat(F.lit("http://h"), F.pmod(F.xxhash64("id"), F.lit(40)), F.lit(".org/"))).alias("url"), F.col("id").cast("string").alias("html"))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path, "run")
    entries = warc.read_archives(spark, path, "run").select(
        warc.url_key(F.col("url")).alias("url_key"), "captured", "page_id", "url", "record_type", "refers_to", F.lit(1).cast("long").alias("payload_bytes"),
        "payload_digest", "record_id", "archive")
    rows = warc.merge_index(entries.repartition(4), range_rows=200, run_rows=70).orderBy("key_range", "position").collect()
    keys = [(r["url_key"].encode(), r["captured"], r["page_id"]) for r in rows]
    assert len(rows) == 3000 and keys == sorted(keys)
    sizes = {}
    for r in rows:
        sizes[r["key_range"]] = sizes.get(r["key_range"], 0) + 1
    assert len(sizes) > 8 and max(sizes.values()) < 1000  # the hot URL is spread


def test_damage_is_found(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "whole")], "page_id long, url string, html string"), path, "run")
    for a, b in (("whole", "whols"), ("whole", "who")):
        bad = scratch_path(spark, "test-warc")
        spark.read.option("lineSep", "\0").text(path).select(F.replace("value", F.lit(a), F.lit(b)).alias("value")).write.option("lineSep", "\0").text(bad)
        with pytest.raises(Exception, match="damaged WARC record"):
            warc.read_archives(spark, bad, "run").collect()


def test_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys(spark, one):
    for url, key in ((None, ""), ("", ")"), ("HTTP://User@Www.Example.COM:80/A/b?C#d", "com,example,www)/a/b?c"), ("no scheme", ")no scheme")):
        assert one(warc.url_key(F.lit(url).cast("string"))) == key


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        data = [rng.randrange(3) for _ in range(20)]
        automaton = licence.SuffixAutomaton(texts)

        def stands(x):
            return sorted((k, i + len(x) - 1) for k, t in enumerate(texts) for i in range(len(t) - len(x) + 1) if t[i:i + len(x)] == x)

        longest = [max(n for n in range(i + 2) if n == 0 or stands(data[i + 1 - n:i + 1])) for i in range(20)]
        want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= 2 and (i == 19 or longest[i + 1] != n + 1)]
        got = automaton.stretches(data, 2)
        assert [(a, n) for a, n, _ in got] == want
        assert all(automaton.ends[s] == stands(data[a:a + n]) for a, n, s in got)


def test_licences_of_documents(spark, docs, odd, none):
    rows = licence.labelled(licence.scan(docs)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or ""))
        places = sorted((i, label) for phrase, label in licence.PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licence.scan(odd).count() == odd.count() and licence.scan(none).isEmpty()


def test_spans_are_chained_over_edits(spark):
    text = "Ünder: Permission is hereby granted free of charge to ANY person obtaining one copy of this software and associated documentation files " \
           "the software to deal in the software without any restriction including without limitation the rights to use copy modify merge publish " \
           "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the " \
           "following conditions. The MIT license; apache\tLICENSE mit license"
    frame = spark.createDataFrame([(1, text), (2, "licensed under cc by 4.0!"), (3, "Licensed under CC BY-NC 4.0")], "doc_id long, text string")
    one, two, three = licence.labelled(licence.scan(frame)).orderBy("doc_id").collect()
    assert one["labels"] == "apache,mit" and one["n_base"] == 3 and 0.9 < one["score"] < 1
    assert (two["labels"], three["labels"], three["score"]) == ("cc-by", "cc-by-nc", 1.0)
    span = licence.scan(frame).where("doc_id = 1").first()["spans"][0]
    assert span["label"] == "mit" and span["start"] == 1


def test_every_copy_of_a_notice_has_a_span():
    scanner = licence.Scanner()
    k, notice = max(((k, text.split()) for k, (label, text) in enumerate(licence.TEMPLATES) if label == "mit"), key=lambda x: len(x[1]))
    edited = notice[:20] + ["edited"] + notice[21:]
    between = ["zzz"] * 8
    text = " ".join(["xxx", *notice, *between, *edited, *between, *notice[:4], *between, *notice, "yyy"])
    n = len(licence.split_words(" ".join(notice)))
    spans = [s for s in scanner.read(text)[2] if s[1] == k]
    starts = [1, 1 + n + 8, 1 + 2 * (n + 8) + 4 + 8]
    assert sorted((a, b) for _, _, a, b, _ in spans) == [(a, a + n) for a in starts]
    assert sorted(c for *_, c in spans)[1:] == [1.0, 1.0]
    many = scanner.read(" ".join([*notice, "zzz"] * 300))[2]
    assert sum(s[1] == k and s[4] == 1.0 for s in many) == 300


def test_equal_entries_are_spread_over_ranges(spark):
    when = F.timestamp_seconds(F.lit(0))
    entries = spark.range(2400).select(F.lit("org,hot)/").alias("url_key"), when.alias("captured"), F.lit(None).cast("long").alias("page_id"),
                                       F.lit("http://hot.org/").alias("url"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
                                       F.lit(1).cast("long").alias("payload_bytes"), F.lit("d").alias("payload_digest"), F.lit("r").alias("record_id"),
                                       F.lit("a").alias("archive"))
    sizes = [r["count"] for r in warc.merge_index(entries, range_rows=200, run_rows=70).groupBy("key_range").count().collect()]
    assert sum(sizes) == 2400 and len(sizes) > 8 and max(sizes) < 800
