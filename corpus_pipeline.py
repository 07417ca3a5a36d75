"""The corpus pipeline: five operators, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  All stages but the last return
the columns of documents.

A document is a doc_id and a text: the stages that look documents up by id get the
64-bit hash of both in place of doc_id, so rows without doc_id, and several texts of one
doc_id, are documents of their own.  Rows that repeat both are one document, of which
near-dedup keeps one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsglass.llm import bpe, decontaminate, minhash, quality, suffix_dedup
from dnsglass.llm.tables import cut, parquet


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, parquet(spark, sf_dir, "labels"))


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the hash of both as doc_id; never null."""
    return docs.select(_document().alias("doc_id"), "text")


def _document() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least doc_id, one
    without doc_id only where no other has one.  Documents without words are not linked
    with others and stay."""
    groups = minhash.near_duplicates(_documents(docs)).select(F.col("doc_id").alias("_document"), F.col("component_id").alias("_group")).distinct()
    ids = docs.select(_document().alias("_document"), F.col("doc_id").alias("_id")).join(groups, "_document")
    kept = ids.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_document")).alias("least")).select("least._document")
    return docs.withColumn("_document", _document()).join(kept, "_document").dropDuplicates(["_document"]).select(docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or an earlier place, holds."""
    return suffix_dedup.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region of a benchmark item, whether they have a doc_id or not."""
    gone = decontaminate.contaminated(_documents(docs), parquet(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_document")).distinct()
    return docs.withColumn("_document", _document()).join(gone, "_document", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", encoded),
]

# The stages train, hash and sort; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = parquet(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
