"""Ranked search against a plain scorer, and what items share against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallywing.llm import lexical
from tallywing.llm.lexical import Best, Sharing, rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, best=10):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counted = [c for c in counted if c[2]]
    n, length = len(counted), sum(c[2] for c in counted)
    held = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c, size in counted:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def test_sharing_adds_up():
    rng = np.random.default_rng(1)
    common = [set(map(int, rng.choice(60, 8, replace=False))) for _ in range(4)]
    items = [set(map(int, rng.choice(60, rng.integers(1, 12)))) | common[rng.integers(4)] for _ in range(80)] + [{59}, {59}, set(range(60))]
    sharing = Sharing(items)
    shares = rng.integers(0, 1000, (60, 7))
    used = [t for g in sharing.groups for t in g]
    assert sorted(used) == sorted(set().union(*items))
    got = sharing.sums(shares[used])
    assert (got == np.array([shares[sorted(s)].sum(axis=0) for s in items])).all()
    plain = sum(len(s) - 1 for s in items)
    shared = sum(len(left) for left, _ in sharing.layers) + sum(len(g) - 1 for g in sharing.groups) + sum(len(v) - 1 for v in sharing.items)
    assert sharing.layers and shared < plain / 2


def test_best_keeps_ties_in_order():
    rng = np.random.default_rng(2)
    best, every = Best(3, 4), []
    for _ in range(20):
        scores, doc = rng.integers(0, 4, (3, 9)), rng.integers(0, 50, 9)
        missing = rng.random(9) < 0.1
        best.add(scores, doc, missing)
        every.append((scores, doc, missing))
    scores, doc, missing = (np.concatenate([e[k] for e in every], axis=-1) for k in range(3))
    want = [(i, *x) for i in range(3) for x in sorted((-s, m, d) for s, m, d in zip(scores[i], missing, doc) if s > 0)[:4]]
    assert list(zip(best.item, -best.score, best.missing, best.doc)) == want


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_against_a_plain_scorer(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "HELD_SUMS", 3000)
    monkeypatch.setattr(lexical, "PART_BYTES", 50)
    rng = random.Random(3)
    words = [*(f"w{i}" for i in range(60)), "Éa", "éa", "K", "k", "x_y", "a1", "中文"]
    docs = [(i % 250 * 3, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)]
    docs += [(None, docs[5][1]), (None, docs[5][1]), (1, None), (2, " .,\0 "), (4, "w1 " * 3000)] + [(10_000 - i, docs[7][1]) for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(40)] + [(3, "w1 w2"), (None, "w3, W4"), (50, docs[7][1]), (50, docs[7][1]), (51, None), (52, "nowhere")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(4)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, rank int")
    got = sorted(map(tuple, rank(frame, asked).collect()), key=repr)
    want = [w for w in brute(docs, [i for i in items if i[1]])]
    assert got == want


def test_empty_tables(spark, odd, none):
    asked = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert rank(none, asked).isEmpty() and rank(odd, asked.where("item_id = 2")).isEmpty()
    assert rank(odd, asked).count() == 3
    assert rank(odd, spark.createDataFrame([(1, "unheard of")], "item_id long, text string").where("false")).isEmpty()
