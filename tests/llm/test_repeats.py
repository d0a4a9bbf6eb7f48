"""Repeated bytes, repeated lines, near duplicates and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywing.llm import dedup_bytes, linededup, minhash, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(docs, length=repeats.LENGTH):
    """doc_id to (bytes, removed, runs, kept), texts in order of id."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if (piece := data[i:i + length]) in seen:
                gone[i:i + length] = True
            seen.add(piece)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[doc] = (len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def got_removed(frame):
    return {r["doc_id"]: (len(r["data"]), r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_bytes.remove_repeats(frame).collect()}


def test_repeated_bytes_of_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got_removed(docs.repartition(3)) == removed(rows)


@pytest.mark.parametrize("buffer", [300, 1 << 20])
def test_repeated_bytes_at_every_edge(spark, monkeypatch, buffer):
    """Passages of 99 to 300 bytes at starts, ends and side by side, periodic texts, overlaps, other scripts, small buffers."""
    monkeypatch.setattr(repeats, "BUFFER", buffer)
    rng = random.Random(4)

    def noise(n, letters="abcdefgh éß"):
        return "".join(rng.choice(letters) for _ in range(n))

    passage, line = noise(300), noise(70)
    rows = [(0, noise(150) + passage + noise(40)), (1, passage[:99]), (2, passage[:100]), (3, noise(30) + passage[50:151] + noise(30)),
            (4, passage + passage), (5, "ab" * 300), (6, "x" * 99), (7, "x" * 250), (8, "xy" + "x" * 120), (9, None), (10, ""),
            (11, noise(60) + line + noise(60)), (12, noise(60) + line + noise(60)), (13, passage[100:220] + "Z" + passage[101:250]),
            (14, "ab" * 60 + noise(20) + "ba" * 60), (None, passage[20:140])]
    rows += [(20 + i, noise(rng.randrange(60)) + passage[a:a + rng.randrange(80, 200)] + line + noise(rng.randrange(60)))
             for i, a in enumerate(rng.randrange(150) for _ in range(25))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_removed(frame) == removed(rows)


def test_repeated_bytes_of_a_text_larger_than_a_buffer(spark):
    """A text of 10 MB that holds shared passages near its start, at the borders of its parts and near its end."""
    rng = np.random.default_rng(6)

    def noise(n):
        return rng.choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), n).tobytes().decode()

    passages = [noise(300) for _ in range(4)]
    long = noise(10_000_000)
    for passage, at in zip(passages, (1000, (4 << 20) - 150, 9 * (1 << 20) - 20, 9_999_000)):
        long = long[:at] + passage + long[at + 300:]
    rows = [(1, long)] + [(2 + i, noise(49) + "X" + p + "X" + noise(49)) for i, p in enumerate(passages)]
    got = got_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {doc: row[:3] for doc, row in got.items()} == {1: (10_000_000, 0, 0), **{2 + i: (400, 300, 1) for i in range(4)}}
    assert all(got[2 + i][3].decode() == text[:50] + text[350:] for i, (_, text) in enumerate(rows[1:]))


def test_repeated_bytes_of_odd_rows(odd, none):
    rows = dedup_bytes.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 4, 7, None))
    spam = next(r for r in rows if r["doc_id"] == 6)
    assert (spam["n_removed"], spam["n_spans"]) == (len("spam " * 60) - 5, 1)  # every string but the first five starts earlier too
    assert dedup_bytes.remove_repeats(none).isEmpty()


def test_repeated_bytes_of_equal_rows(spark):
    text = "".join(random.Random(1).choices("abcdef", k=150))
    rows = dedup_bytes.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (2, 150)]


def test_repeated_in_against_a_loop():
    rng = np.random.default_rng(0)
    for _ in range(50):
        order, same = rng.integers(0, 4, 30), rng.integers(0, 5, 30)
        want = [any(same[j] == same[i] and order[j] < order[i] for j in range(30)) for i in range(30)]
        assert repeats.repeated_in((order,), (same,)).tolist() == want


def lines_removed(docs, least):
    first, every = {}, {}
    for doc, text in sorted(docs):
        lines, counts, _ = linededup.worded(text)
        runs = []
        for a in range(len(lines)):
            b, held = a, 0
            while b < len(lines) and held < least:
                held += counts[b]
                b += 1
            if held < least:
                break
            if first.setdefault(tuple(lines[a:b]), (doc, a)) != (doc, a):
                runs.append((a, b - 1))
        every[doc] = linededup.without(text, runs)
    return every


@pytest.mark.parametrize("buffer", [200, 1 << 20])
def test_lines_against_a_loop(spark, docs, monkeypatch, buffer):
    monkeypatch.setattr(linededup, "BUFFER_CHARS", buffer)
    rng = random.Random(7)
    pool = ["one two three", "four five six seven", "eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "", "  ", "x", "y z"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(60)]
    for frame, data in ((spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows),
                        (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["kept_words"], r["first_removed"])
               for r in linededup.remove_lines(frame.select("doc_id", "text")).collect()}
        assert got == lines_removed(data, linededup.LEAST_WORDS)


def covered_lines_removed(docs, least):
    """Every line goes that a run of lines with ``least`` words covers which stands earlier, whatever its ends."""
    first, every = {}, {}
    for doc, text in sorted(docs):
        lines, counts, _ = linededup.worded(text)
        runs = [(a, b) for a in range(len(lines)) for b in range(a, len(lines)) if sum(counts[a:b + 1]) >= least]
        every[doc] = linededup.without(text, [(a, b) for a, b in runs if first.setdefault(tuple(lines[a:b + 1]), (doc, a)) != (doc, a)])
    return every


@pytest.mark.parametrize("buffer", [200, 1 << 20])
def test_matches_extend_both_ways(spark, monkeypatch, buffer):
    monkeypatch.setattr(linededup, "BUFFER_CHARS", buffer)
    rng = random.Random(8)
    pool = ["one two three", "four five six seven", "eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen", "", "  ", "x", "y z"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["kept_words"], r["first_removed"])
           for r in linededup.remove_lines(frame, both_ways=True).collect()}
    assert got == covered_lines_removed(rows, linededup.LEAST_WORDS) != lines_removed(rows, linededup.LEAST_WORDS)


def test_line_stage_leaves_no_stump(spark, odd, small):
    """The last line of a copy, too short for a window of its own, goes with the line before; a copy with nothing else goes."""
    long = "a line of more than ten words which two texts share in full"
    texts = [f"first\n{long}\nits end", f"second\n{long}\nits end\nand more", f"{long}\nits end"]
    row = odd.where("doc_id = 1").drop("doc_id", "text")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").crossJoin(row)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, frame, small).collect()}
    assert got == {0: texts[0], 1: "second\nand more"}


def test_lines_of_odd_rows(odd, none):
    cut = linededup.remove_lines(odd)
    assert cut.columns == [*odd.columns, "n_lines", "_n_removed", "kept_words", "first_removed"]
    rows = cut.collect()
    assert [r["text"] for r in rows if r["doc_id"] == 7] == ["", ""] and [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert all(r["_n_removed"] == 0 for r in rows if r["doc_id"] != 7) and {r["n_removed"] for r in rows} == {5}
    assert linededup.remove_lines(none).isEmpty()


def shingled(text, n=5):
    words = WORD.findall(text or "")
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else Counter([tuple(words)] if words else [])


def test_shingles_are_those_of_words():
    texts = ["a b c d e f", "  a\tb c\nd e ", "a b c d e", "", "x y", "a b c d e a b c d e", "é ß ü a b c"]
    names = {}
    for text, (hashes, counts) in zip(texts, minhash.shingles([t.encode() for t in texts])):
        want = shingled(text)
        assert sorted(counts.tolist()) == sorted(want.values()) and len(set(hashes.tolist())) == len(want)
        names[text] = set(hashes.tolist())
    assert names[texts[1]] == names[texts[2]] and names[texts[1]] <= names[texts[0]] & names[texts[5]]


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(9)
    hashes = np.sort(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    a = rng.integers(1, 6, 400) * 1.7
    b = np.where(rng.random(400) < 0.3, a * 2, a)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = minhash.band_names(hashes, a, 4096, 1) == minhash.band_names(hashes, b, 4096, 1)
    assert abs(same.mean() - want) < 0.03
    assert minhash.similarity((hashes, a), (hashes, b)) == pytest.approx(want)


def edited(rng, words, share):
    return " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("tile, crowd", [(2, 2), (256, 32)])
def test_classes_against_all_pairs(spark, monkeypatch, tile, crowd):
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice((30, 120, 400)))] for _ in range(12)]
    texts = [" ".join(b) for b in base] + [edited(rng, b, share) for b in base for share in (0.005, 0.01, 0.02, 0.03, 0.05)]
    texts += [texts[0]] * 5 + ["one two", "one two", "one", "", None, " \n"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = minhash.cell_weights(frame.select(F.coalesce("text", F.lit("")).cast("binary").alias("data")), 5, minhash.CELLS)
    vectors = {}
    for i, text in rows:
        hashes, counts = minhash.shingles([(text or "").encode()])[0]
        vectors[i] = hashes, counts * weights[minhash.cell_of(hashes, len(weights))]
    label = {i: i for i, _ in rows}
    for i, _ in rows:
        for j in range(i):
            if len(vectors[i][0]) and minhash.similarity(vectors[i], vectors[j]) >= 0.8:
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.classes(frame).collect()}
    sizes = Counter(label.values())
    assert got == {i: (label[i], sizes[label[i]]) for i, _ in rows}
    kept = minhash.keep_one(frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values()))


def test_tiles_find_a_link_for_each_that_has_one():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
    weight = dict(zip(pool.tolist(), rng.random(60) + 0.5))

    def text(k):
        hashes = np.sort(rng.choice(pool, 45, replace=False))
        return bytes([k]), (hashes, rng.integers(1, 3, 45), np.asarray([weight[h] for h in hashes.tolist()]))

    left, right = [text(k) for k in range(40)], [text(100 + k) for k in range(50)]
    whole = {n: (v[0], v[1] * v[2]) for n, v in left + right}
    best = {a: max(minhash.similarity(whole[a], whole[b]) for b, _ in right) for a, _ in left}
    least = sorted(best.values())[20]
    got = dict(minhash.tile_links(left, right, least, False))
    assert set(got) == {a for a, n in best.items() if n >= least}
    assert all(minhash.similarity(whole[a], whole[b]) >= least for a, b in got.items())
    every = {(a, b) for a, _ in left for b, _ in left if a != b and minhash.similarity(whole[a], whole[b]) >= least}
    assert set(minhash.tile_links(left, left, least, True)) == every and every


def test_links_beyond_the_leader_are_found(spark):
    """A chain in which the ends are not similar is one class, whoever leads a bucket."""
    words = [f"c{i}" for i in range(300)]
    texts = []
    for step in range(6):
        texts.append(" ".join(words))
        for k in range(4):
            words[50 * step + 7 * k] = f"n{step}x{k}"
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["class_id"] for r in minhash.classes(frame).collect()} == {0}


def test_components(spark):
    rows = [(i, i + 1) for i in range(10, 30)] + [(1, 40), (2, 40), (3, 40)]
    frame = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in rows], "a binary, b binary")
    got = {bytes(r["node"])[0]: bytes(r["class"])[0] for r in minhash.components(frame).collect()}
    assert got == {**{i: 10 for i in range(10, 31)}, 1: 1, 2: 1, 3: 1, 40: 1}


def test_classes_of_odd_rows(odd, none):
    got = sorted(((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in minhash.classes(odd).collect()))
    assert got == [(0, 0, 1), (1, 1, 3), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 1, 3), (7, 1, 3), (9, 9, 1), (9, 9, 1)]
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1, 2, 3, 4, 5, 6, 9, 9])
    assert minhash.classes(none).isEmpty() and minhash.keep_one(none).isEmpty()


def test_frequent_shingles_weigh_less(spark):
    frame = spark.createDataFrame([(f"common start of all texts here r{i} s{i} t{i} u{i} v{i}".encode(),) for i in range(50)], "data binary")
    weights = minhash.cell_weights(frame, 5, 1 << 18)
    cells = minhash.cell_of(minhash.shingles([b"common start of all texts"])[0][0], 1 << 18), minhash.cell_of(minhash.shingles([b"r1 s1 t1 u1 v1"])[0][0], 1 << 18)
    assert weights[cells[0]] == pytest.approx(math.log(2)) and weights[cells[1]] > 3


def test_a_group_of_a_third_of_all_rows_is_judged_like_a_small_one(spark):
    """Copies of one text with 2 or 3 of 200 words changed: the similarity does not fall as the group grows."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(200)]

    def copy(k):
        words = list(base)
        for i in range(rng.choice((2, 3))):
            words[20 + 60 * i + rng.randrange(40)] = f"edit{k}x{i}"
        return " ".join(words)

    texts = [" ".join(base)] + [copy(k) for k in range(99)] + [" ".join(f"o{k}x{rng.randrange(10**6)}" for _ in range(200)) for k in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    weights = minhash.cell_weights(frame.select(F.col("text").cast("binary").alias("data")), 5, minhash.CELLS)
    whole = [(h, n, n * weights[minhash.cell_of(h, len(weights))]) for h, n in minhash.shingles([t.encode() for t in texts[:100]])]
    pairs = [(minhash.similarity((whole[i][0], whole[i][1]), (whole[j][0], whole[j][1])), minhash.similarity((whole[i][0], whole[i][2]), (whole[j][0], whole[j][2])))
             for i in range(100) for j in range(i)]
    near = [(plain, weighted) for plain, weighted in pairs if 0.8 <= plain <= 0.95]
    assert len(near) > 100 and max(abs(plain - weighted) for plain, weighted in near) < 0.03
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.classes(frame).collect()}
    assert got == {i: (0, 100) if i < 100 else (i, 1) for i in range(300)}


def test_pipeline(spark, small, odd, none):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "pack"]
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.count() > 50 and pieces.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for table in (odd.drop("t"), none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, small)
            assert out.columns == table.columns and out.dtypes == table.dtypes
            table = out
        corpus_pipeline.STAGES[-1][1](spark, table, small).count()


def test_line_stage_drops_what_is_emptied_and_counts_anew(spark, odd, small):
    rows = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, odd.where("doc_id in (1, 2, 4, 7)"), small).collect()}
    assert set(rows) == {1, 2, 4} and rows[1]["n_chars"] == len(rows[1]["text"])


def clashing(spark, make, n=400_000):
    """Two different texts with one crc32, the first built around ``make``'s passage."""
    import zlib

    seen = {}
    for i in range(n):
        for k in (0, 1):
            text = make(k, hashlib.md5(str(i).encode()).hexdigest()[:16])
            other = seen.setdefault(zlib.crc32(text.encode()), (k, text))
            if other[0] != k:
                return (other[1], text) if other[0] == 0 else (text, other[1])
    raise AssertionError("no clash found")


@pytest.mark.parametrize("doc", [7, None])
def test_texts_of_one_id_and_equal_crc_are_told_apart(spark, doc):
    passage, unique = ("".join(random.Random(seed).choices("abcdefghijklmnop", k=150)) for seed in (1, 2))
    one, two = clashing(spark, lambda k, i: (passage if k == 0 else unique) + f" {i}")
    rows = [(-5, "before " + passage), (doc, one), (doc, two)] if doc else [(doc, one), (doc, two), (1, passage)]
    got = dedup_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {r["data"].decode(): r["n_removed"] for r in got}
    assert removed[two] == 0 and (removed[one] >= 150 if doc else removed[passage] == 150)


@pytest.mark.parametrize("doc", [7, None])
def test_lines_of_one_id_and_equal_crc_are_told_apart(spark, doc):
    line = "one two three four five six seven eight nine ten"
    one, two = clashing(spark, lambda k, i: (line if k == 0 else "ten other words that stand in no other text at all") + f"\n{i}")
    rows = [(-5, line + "\nbefore"), (doc, one), (doc, two)] if doc else [(doc, one), (doc, two), (1, line)]
    got = {r["kept_words"] for r in linededup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).where(
        F.col("doc_id").isNull() if doc is None else F.col("doc_id") == doc).collect()}
    assert 12 in got
