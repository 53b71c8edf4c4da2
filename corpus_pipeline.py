"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, or made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabgraph.llm import bytebpe, mixing, quality, simhash
from tabgraph.llm.common import load, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from docs' own labelled rows, scores at 0.7 or more."""
    return quality.accepted(spark, docs, load(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no anomalies to the isolation forest."""
    return quality.within_rules(spark, docs, load(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicated(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate takes them."""
    return mixing.mixed(spark, docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids by number and hash, and the hash of what they decode to, in place of its text."""
    return bytebpe.encoded(docs.select("doc_id", "text"), digest=True)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("bpe_encoding", bpe_encoding)]

#: The stages learn models and draw hashes that SQL cannot express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
