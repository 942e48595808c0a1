"""From raw documents to packed sequences. Each stage's rows are written and reread before the next one starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cambium.llm import jaccard, packing, quality, rules, winnow
from cambium.llm.common import Scratch, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    Whole rows with all columns stay, repeats each; equal texts are judged alike, a null text like an empty one. Without
    two labelled rows of either label the score is the share of label 1. An empty table gives an empty table.
    """
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects.

    Whole rows with all columns stay, repeats each. Null and empty texts have no words and go, as do all of under 50 words.
    A null language is a stratum of its own. An empty table gives an empty table.
    """
    return rules.keep_passed(spark, docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows without words, or without an id, all stay; rows that repeat an id and a text are one; of an id with unlike texts
    each is a row of its own. An empty table gives an empty table.
    """
    return jaccard.keep_one(spark, docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by the benchmark.

    Whole rows with all columns stay as they are, null texts too, repeats each; a text without words is never contaminated.
    An empty table gives an empty table.
    """
    return winnow.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens.

    A null text is an empty one and has a piece of its end id; rows that repeat are packed each; other columns don't
    matter. An empty table gives an empty table.
    """
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Classifier, tokenizer and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
