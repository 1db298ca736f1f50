"""The corpus pipeline: quality rules, near-duplicates, repeated passages, test items, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents, extra ones of any name included; a stage drops rows or shortens texts, and
changes nothing else. Null and empty texts fail the quality rules; rows with a null id are kept or dropped by their text, and are
never the one that stays of a group unless all its ids are null; of equal rows one stays; an empty table goes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, near_dups, quality, suffix_dedup
from scriptorium.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the tokeniser bands keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dups.one_of_each(docs, words=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated strings of 400 bytes and repeated passages of over 50 words, here or elsewhere; a document may be left empty, null texts stay null."""
    return suffix_dedup.remove(docs, words=50).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and decoded text."""
    return bpe.encode(docs, digests=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("test_items", test_items), ("token_ids", token_ids)]
#: No SQL expresses the tokeniser measures, the merges and the byte strings; tests/llm compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
