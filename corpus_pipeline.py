"""Corpus pipeline: toxicity, quality, near-duplicates, decontamination, mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents it keeps, which are written and reread for the next
one.  All but the last return the columns of ``documents``; the last adds the
place of each document in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from suiteforge.llm import decontam, neardup, pfair, quality, toxicity
from suiteforge.llm.common import stored
from suiteforge.session import read_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of its input; documents scored 0.5 or more go."""
    return toxicity.reject(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the weak-label scorer go."""
    return quality.reject(docs, quality.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    return neardup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts."""
    return decontam.remove(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources."""
    return pfair.mix(docs)


STAGES = [("toxicity", toxic), ("quality", low_quality), ("near duplicates", near_duplicates), ("decontaminate", leaks), ("mix", mix)]

#: Fitted models cannot be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
