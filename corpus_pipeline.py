"""A training corpus from `documents`: known languages only, near-duplicates once, long repeats once, no benchmark text, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written to the shared folder
and reread. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiweave.llm import decontam, langid, nearcopies, packing, substring
from lexiweave.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and junk by the measure of the language found, go; lang is what was found."""
    return langid.only_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a similarity of 0.8 or more (shingles of five words) the smallest doc_id stays."""
    return nearcopies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words and more that a smaller doc_id has too go, and documents of which nothing is left."""
    return substring.without_repeats(docs, window=50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 13 words of the benchmark go, and those of whose words a twentieth or more are in its phrases."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), size=13)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document lie in sequences of 1024 tokens."""
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("language-id", language_id),
    ("simhash-near-dedup", simhash_near_dedup),
    ("substring-dedup", substring_dedup),
    ("benchmark-decontamination", benchmark_decontamination),
    ("best-fit-packing", best_fit_packing),
]

#: SQL has no tokenizer, no XXH64 and no support vector machines; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
