"""A corpus pipeline over `documents`: language, exact and near duplicates, benchmark passages, packing.

Every stage works on all rows its predecessor kept and returns the columns of `documents`, but for the last one, which
returns the packed pieces. `run` writes each stage's rows to the folder that all executors share and reads them again, so
a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseloom.llm import common, exact_dedup, jaccard_join, language_id, packing, wu_manber


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell with some margin; undetermined ones go."""
    return language_id.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under five-word shingles and similarity 0.8."""
    return jaccard_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a window of ten benchmark words."""
    return wu_manber.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


#: Vocabulary pieces that a worker remembers here, where its memory has served other stages before.
REMEMBERED = 500_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents that are left, in sequences of at most 2048 tokens."""
    return packing.pack(docs, memory=REMEMBERED)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Compression classification and tokenization are not in SQL; the tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch() as keep:
        for name, stage in STAGES[:-1]:
            with common.scratch() as keep_stage:  # what a stage wrote for itself goes with it
                docs = keep_stage(common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            common.release(spark)
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
