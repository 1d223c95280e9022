"""A corpus from raw documents to sorted shards: quality rules, near duplicates, decontamination, mixture, shards.

Every stage is written as Parquet and read again by the next. All stages but the last return the columns of their input, whatever these are called, and take an empty table to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import compression_rules, jaccard_join, pareto_mix, scratch, sstable, suffix_decontam


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents out of the compression bands go; so do null and empty texts. Null ids stay, and repeated rows are judged alike."""
    return compression_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates, the document with the smallest id stays. Rows with a null id or without a token stay; of rows that repeat an id the one with the least text stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that share a passage with the benchmark go, each row by itself, also those with a null id. Null and empty texts share none."""
    return suffix_decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sources are sampled to their target weights. A null source is one of its own, null sizes count as 0; a document is repeated as often as it is taken, and ties at the last place are broken so that every source has its number exactly."""
    return pareto_mix.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row for each sorted-string-table shard. Null ids come first; rows that repeat an id are all stored."""
    return sstable.tables(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL has no zstandard; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
    return docs
