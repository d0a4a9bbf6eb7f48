"""A corpus from raw documents to packed sequences; each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.llm import linededup, minhash, mixing, packing, rules
from tallywing.llm.common import settle, table
from tallywing.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines. One of which no word is left goes; ``n_chars`` follows the text."""
    cut = linededup.remove_lines(docs, both_ways=True)
    left, removed = cut.columns[-2], cut.columns[-3]
    kept = cut.where((F.col(left) > 0) | (F.col(removed) == 0))
    return kept.select(*[F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
                         if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 ids, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("pack", pack)]

#: The rules are learned and near duplicates sampled, so SQL cannot tell the rows; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
