"""Corpus pipeline: from ``documents`` to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of ``documents``. ``run`` chains them over the table, each written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedspark.llm import decontaminate, line_dedup, minhash_dedup, packing, quality_rules
from feedspark.llm.tables import read, stored
from feedspark.session import checkpoint_dir

#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    checkpoint_dir(spark)
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go, but in the last document that holds them."""
    checkpoint_dir(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    checkpoint_dir(spark)
    return minhash_dedup.keep_one_of_each(docs, words=SHINGLE_WORDS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go."""
    checkpoint_dir(spark)
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    checkpoint_dir(spark)
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near_duplicates),
          ("decontaminate", benchmark), ("packing", pack)]

#: Signatures, alignments and a tokenizer cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
