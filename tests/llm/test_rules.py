"""Text statistics, the decision list and the additive model."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallywing.llm import gam, rules
from tallywing.llm.common import labels_of
from tallywing.llm.textstats import features, with_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics(odd, docs):
    for table in (odd.select("doc_id", "text"), docs.select("doc_id", "text")):
        for r in with_statistics(table).collect():
            s = r["stats"]
            assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"]) == counted(r["text"]), r["doc_id"]


def test_repeats_touching_and_overlapping(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e", "a b c d", "x #1 | y\nx #1 | y\n\n\nz z"]
    rows = with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["stats"]["n_repeat_words"] for r in rows] == [counted(t)[4] for t in texts]
    assert rows[4]["stats"]["n_dup_lines"] == 1 and rows[4]["stats"]["n_symbols"] == 4


def test_list_is_learned_and_applied(docs, labels):
    judged = rules.judge(docs, labels)
    assert judged.count() == docs.count()
    known = judged.join(labels_of(labels, "quality"), "doc_id").where("not base_failed")
    right = known.where("kept = (label = 1)").count()
    assert right >= 0.9 * known.count()
    assert judged.where("base_failed and kept").isEmpty()


def test_rules_read_in_order():
    a = rules.Rule((("n_words", "<=", 3.0), ("mean_word", ">", 2.0)))
    assert str(a) == "n_words <= 3 and mean_word > 2"


def test_keep_returns_the_columns(odd, none, labels):
    kept = rules.keep(odd, labels)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} <= {1, 5, 7, None, 9}
    assert kept.where("doc_id in (2, 3, 4, 6)").isEmpty()
    named = rules.keep(odd.withColumn("Tallywing_Stats", F.lit(1)), labels)
    assert named.columns == [*odd.columns, "Tallywing_Stats"] and named.count() == kept.count()
    assert rules.keep(none, labels).isEmpty() and rules.judge(none, labels).isEmpty()


def test_without_labels_only_the_base_rule_holds(odd, labels):
    judged = rules.judge(odd, labels.where("doc_id < 0"))
    assert judged.where("kept = base_failed").isEmpty()


def test_conflicting_and_null_labels_are_left_out(spark):
    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)]
    assert labels_of(spark.createDataFrame(rows, "doc_id long, quality int"), "quality").collect() == [(1, 1)]


def test_model_separates_and_scores_as_numpy(docs, labels):
    statistics = with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats")
    model = gam.learn(statistics, labels_of(labels, "quality"))
    columns = features()
    rows = statistics.select("doc_id", model.score(columns).alias("score"), *[c.alias(n) for n, c in columns.items()]).toPandas()
    want = 1 / (1 + np.exp(-model.odds(rows[list(columns)].to_numpy(float))))
    assert np.allclose(rows["score"], want, atol=1e-12)
    scored = gam.score(docs, labels).join(labels_of(labels, "quality"), "doc_id").where("held_out")
    assert scored.where("predicted = label").count() >= 0.85 * scored.count()


def test_model_learns_a_pairwise_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert ((model.odds(x) > 0) == (y > 0)).mean() > 0.97
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)


def test_score_of_odd_rows(odd, none, labels):
    scored = gam.score(odd, labels)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1 or held_out is null").isEmpty()
    assert scored.where("predicted <> cast(score >= 0.7 as int)").isEmpty()
    assert gam.score(none, labels).isEmpty()
    assert gam.score(odd, labels.where("doc_id < 0")).select(F.countDistinct("score")).first()[0] == 1


def test_one_bin_or_no_rows_give_a_constant():
    assert gam.fit(np.zeros((0, 3)), np.zeros(0)).tables == []
    assert np.allclose(gam.fit(np.ones((20, 2)), np.arange(20) % 2).odds(np.ones((1, 2))), 0, atol=0.1)


def test_the_sample_is_bounded(docs, labels, monkeypatch):
    sizes = []
    monkeypatch.setattr(gam, "fit", lambda x, y: sizes.append(len(y)) or gam.Model(0.0))
    statistics = with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats")
    for sample in (10, 10_000):
        gam.learn(statistics, labels_of(labels, "quality"), sample)
    assert sizes == [10, statistics.join(labels_of(labels, "quality"), "doc_id").where(~gam.held_out(F.col("doc_id"))).count()]
