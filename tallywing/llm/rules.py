"""Quality rules: a learned decision list over statistics of whole texts.

Sequential covering: a rule is a conjunction of thresholds, grown one threshold at a time on two thirds of the labelled
documents for the largest information gain, then cut back on the other third; the rows it covers leave and the next
rule is grown. The result is an ordered list that becomes one Spark conditional expression. Learning is done by
aggregates: each step counts the labels by feature and threshold cell, so that the driver sees at most
``len(FEATURES) * cuts`` rows, whatever the number of labelled documents, and all of them are used.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import free_names, labels_of, settle
from tallywing.llm.textstats import FEATURES, features, with_statistics

#: Base rule: fewer words than this, or more than this many in a hundred words repeated, fails.
LEAST_WORDS, MOST_REPEATED = 10, 20


@dataclass(frozen=True)
class Rule:
    """All of ``terms`` (feature, ``<=`` or ``>``, threshold) hold: the document is rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def condition(self, columns: dict[str, Column]) -> Column:
        held = F.lit(True)
        for name, sign, cut in self.terms:
            held = held & (columns[name] <= F.lit(cut) if sign == "<=" else columns[name] > F.lit(cut))
        return held

    def __str__(self) -> str:
        return " and ".join(f"{name} {sign} {cut:.6g}" for name, sign, cut in self.terms)


def base_failed(stats: str = "stats") -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """1 where the list keeps a document, 0 where its first matching rule rejects it, as one ordered expression."""
    columns, chain = features(stats), None
    for rule in rules:
        chain = F.when(rule.condition(columns), 0) if chain is None else chain.when(rule.condition(columns), 0)
    return F.lit(1) if chain is None else chain.otherwise(1)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return 0.0 if not p else p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(statistics: DataFrame, labels: DataFrame, cuts: int = 48, most_rules: int = 12, most_terms: int = 4,
          least_precision: float = 0.9, least_cover: int = 10) -> list[Rule]:
    """The decision list for label 0 (reject) of ``labels`` (doc_id, label) on ``statistics`` (doc_id, stats).

    No rule is returned where there are no labels of either kind. A rule enters only if at least ``least_precision`` of
    what it covers on the pruning third, and of what it covers in all, has label 0. Which third a document is in
    follows from its id. Ties go to the first feature, lower threshold. A repeated doc_id counts as often as it stands.
    """
    known = statistics.join(labels, "doc_id").select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), (F.lit(1) - F.col("label")).alias("bad"),
        *[column.alias(name) for name, column in features().items()])
    known = settle(known, "rule-labels")
    steps = [i / cuts for i in range(cuts)]
    found = known.groupBy("bad").agg(*[F.percentile_approx(name, steps, 10_000).alias(name) for name in FEATURES]).collect()
    if len(found) < 2:
        return []
    seen = {name: sorted({float(x) for row in found for x in row[name]}) for name in FEATURES}
    limits = {name: [(a + b) / 2 for a, b in zip(v, v[1:])] or v for name, v in seen.items()}  # halfway between values seen

    def cell(name: str) -> Column:
        """How many thresholds of the feature lie below the value."""
        return F.size(F.filter(F.array(*map(F.lit, limits[name])), lambda cut: F.col(name) > cut)).alias(f"cell_{name}")

    alive = settle(known.select("*", *map(cell, FEATURES)), "rule-cells")
    tall = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"cell_{name}").alias("c")) for i, name in enumerate(FEATURES)]))

    def counted(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
        sums = rows.select("bad", tall.alias("at")).groupBy("at.f", "at.c").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        return {(FEATURES[r["f"]], r["c"]): (r["p"], r["n"]) for r in sums.collect()}

    def held(terms) -> Column:
        return Rule(tuple(terms)).condition({name: F.col(name) for name in FEATURES})

    rules: list[Rule] = []
    while len(rules) < most_rules:
        terms: list[tuple[str, str, float]] = []
        while len(terms) < most_terms:
            cells = counted(alive.where(~F.col("prune")).where(held(terms)))
            by_name = defaultdict(dict)
            for (name, c), pair in cells.items():
                by_name[name][c] = pair
            if not by_name:
                break
            one = next(iter(by_name.values())).values()
            p0, n0 = sum(p for p, _ in one), sum(n for _, n in one)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for name in FEATURES:
                p = n = 0
                for i, cut in enumerate(limits[name]):  # cells 0..i lie at or below the cut
                    more = by_name[name].get(i, (0, 0))
                    p, n = p + more[0], n + more[1]
                    for sign, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if x >= least_cover and (g := _gain(x, y, p0, n0)) > best[0]:
                            best = (g, (name, sign, cut))
            if best[1] is None:
                break
            terms.append(best[1])
        if not terms:
            break
        sums = alive.agg(*[
            F.coalesce(F.sum(F.when(held(terms[: k + 1]) & on, value)), F.lit(0)).alias(f"{tag}{k}")
            for k in range(len(terms)) for tag, on, value in (
                ("pp", F.col("prune"), F.col("bad")), ("pn", F.col("prune"), 1 - F.col("bad")),
                ("ap", F.lit(True), F.col("bad")), ("an", F.lit(True), 1 - F.col("bad")))]).first()
        worth = [(sums[f"pp{k}"] - sums[f"pn{k}"]) / max(1, sums[f"pp{k}"] + sums[f"pn{k}"]) for k in range(len(terms))]
        k = max(range(len(terms)), key=lambda i: (worth[i], -i))
        sure = lambda p, n: p >= least_precision * (p + n)
        if sums[f"ap{k}"] < least_cover or not sure(sums[f"pp{k}"], sums[f"pn{k}"]) or not sure(sums[f"ap{k}"], sums[f"an{k}"]):
            break
        rules.append(Rule(tuple(terms[: k + 1])))
        alive = alive.where(~held(rules[-1].terms))
    return rules


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document, written once to the shared folder: numbers only, no text."""
    return settle(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "rule-stats")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, stats, base_failed, kept) of every row of ``docs``; the list is learned from their labels.

    A NULL text has no words and fails the base rule. Repeated rows are judged alike; an empty table gives no rows.
    """
    statistics = measure(docs)
    rules = learn(statistics, labels_of(labels, "quality"))
    failed = base_failed()
    return statistics.select("doc_id", "stats", failed.alias("base_failed"), (~failed & (verdict(rules) == 1)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the base rule and the list keep.

    A NULL text goes; repeated rows are judged alike; an empty table gives no rows. A column may have any name.
    The texts are counted a second time where the list is applied: that costs less than carrying them through a join.
    """
    rules = learn(measure(docs), labels_of(labels, "quality"))
    (stats,) = free_names(docs.columns, "tallywing_stats")
    counted = with_statistics(docs, into=stats)
    return counted.where(~base_failed(stats) & (verdict(rules, stats) == 1)).drop(stats)
