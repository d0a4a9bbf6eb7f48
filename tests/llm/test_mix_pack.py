"""Mixing to target weights, and packing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import mixing, packing
from tallywing.llm.queries import tokenizer_path


def filled(sizes, weights, share, most):
    """Targets by giving the excess out again until none is above."""
    target, open_, left = {}, set(sizes), share * sum(sizes.values())
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [[10, 1000, 20, 500, 3], [5], [0, 7, 7], [100, 1, 1, 1, 1, 1], [0, 0]])
def test_targets_are_filled_like_water(spark, sizes):
    rows = [(f"s{i}" if i else None, 1, n) for i, n in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, n_docs long, source_size long")).collect()}
    order = sorted((s for s, _, _ in rows if s)) + [None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    want = filled({s: n for s, _, n in rows}, weights, 1.5, 2)
    assert got == pytest.approx(want, abs=1e-6)


def test_mix_meets_targets_and_agrees_with_itself(docs):
    first = mixing.mix(docs)
    per = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"),
                                      F.sum("size").alias("size"), F.max("source_size").alias("stated")).collect()
    for r in per:
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["size"] == r["stated"]
    assert first.where("taken not in (0, size, 2 * size)").isEmpty()
    again = mixing.mix(docs.repartition(5))
    assert first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()


def test_cut_off_against_a_sort(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), int(n)) for x, n in zip(np.round(rng.random(3000) ** 4, 3), rng.integers(1, 9, 3000))]
    frame = spark.createDataFrame(rows, "finish double, size long").cache()
    by = {}
    for x, n in rows:
        by[x] = by.get(x, 0) + n
    for budget in (0, 3, 700, 5000, 10**9):
        spent, last = 0, -1.0
        for x in sorted(by):
            if spent + by[x] > budget:
                break
            spent, last = spent + by[x], x
        assert mixing.cut_off(frame, budget) == last


def test_order_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 7)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    queue, _ = mixing.serve(docs, mixing.WEIGHTS, 1.5, 2, 17)
    rows = sorted(queue.select("place", F.col("finishes")[0].alias("f")).collect())
    assert [round(r["f"] * 600 * 1.5) for r in rows] == [2 * (i + 1) for i in range(300)]


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("taken is null or target is null or taken > 2 * size").isEmpty()
    assert mixing.mix(none).isEmpty() and mixing.take(none).isEmpty()
    taken = mixing.take(odd)
    assert taken.columns == odd.columns
    assert taken.count() == got.where("size > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]


def encoded(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [1] for e in found]


def check_pieces(rows, length=2048):
    sequences = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return sequences


def test_pack_holds_every_id_once(docs):
    rows = packing.pack(docs.repartition(3), tokenizer_path(), open_windows=8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = dict(zip(texts, encoded(texts.values())))
    sequences = check_pieces(rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, ids in want.items():
        parts = sorted(by[doc], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == ids
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) for r in parts)
    ends = [sum(n for _, n in parts) for parts in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in ends)
    assert padding < 0.05 * sum(ends)


def test_pack_of_odd_rows(odd, none):
    rows = packing.pack(odd, tokenizer_path()).collect()
    check_pieces(rows)
    texts = [r["text"] for r in odd.select("text").collect()]
    assert sum(r["length"] for r in rows) == sum(map(len, encoded(texts)))
    assert packing.pack(none, tokenizer_path()).isEmpty()


def test_word_ids_are_those_of_the_whole_text():
    table = packing.WordIds(tokenizer_path())
    texts = ["I'm don't 'tis ‘x’ <|endoftext|> a<|startoftext|>b", "A\x1cb c", "İstanbul ΣΑΣ. ΣΑΣ", "été É, (word)..", "a.. b ,. c_. d",
             "日本語、テスト。 中文", "a b c\u0085d", "K. ŉ ﬁ", "THE!! The, the.\nThe", "x'll. it's!' 'll,", "", " \n", "<|ENDOFTEXT|>"]
    got = [np.frombuffer(b, "<u4").tolist() + [1] for b in table.texts(texts)]
    assert got == encoded(texts)


@pytest.mark.parametrize("sizes, windows, left", [
    ([5, 6, 4, 3, 8, 12], [[1, 2], [5], [0, 3, 5]], [[4]]),
    ([6, 7, 8], [[1]], [[2], [0]]),  # the fullest goes when the third fits none
])
def test_best_fit(sizes, windows, left):
    closing, got = packing.best_fit([(i, bytes(4 * n)) for i, n in enumerate(sizes)], 10, 2), []
    while True:
        try:
            got.append([p[0] for p in next(closing)])
        except StopIteration as stop:
            assert (got, [[p[0] for p in w] for w in stop.value]) == (windows, left)
            return


def test_ids_of_fuzzed_texts(monkeypatch):
    """Words one by one give the tokenizer's own ids: rare letters, texts not in NFC, marks in a row, special tokens, and a small table of words."""
    import public_tokenizers

    table = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert table.by_words
    rng = random.Random(5)
    letters = [*"ab Z.,'\"-_!?<|>\n\t0", "é", "e\u0301", "İ", "i\u0307", "ß", "Σ", "ς", "中", "😀", "\u00a0", "\u2028", "\x1c", "ﬁ", "Ǆ", "'s", "'LL", " .", ". ", ", ", "__", ").", "ſ", "K", "२"]
    for most in (40, 500_000):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        for _ in range(30):
            texts = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(1000)]
            want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in table.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert table.texts(texts) == want


def test_a_vocabulary_with_other_rules_is_not_split_into_words(tmp_path):
    import json

    import public_tokenizers

    rules = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    rules["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules))
    table = packing.WordIds(str(path))
    assert not table.by_words
    text = "Some Words in Upper case."
    assert table.texts([text]) == [np.asarray(table.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]
