"""Registered queries of the word operators (11 to 13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, passage_dedup, periodic
from .tables import parquet


def op11_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passage_dedup.without_passages(parquet(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32 of the decimal doc_id is a multiple of 10, the words from
    a place of the text on repeat the first few after it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.expr("div(crc32(cast(doc_id as string)), 10)").alias("g"),
                       F.when(h % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    rows = rows.withColumn("p", F.expr("cast(1 + div(n - a, 3 + g % 8) as int)"))
    planted = F.expr("array_join(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(div(n - a, p) as int))), slice(w, a + 1, cast((n - a) % p as int))), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNotNull() & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_periods(parquet(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as back, -r.period as small)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.small")).alias("period"),
        F.expr("div(1000 * best.length, -best.small)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(parquet(spark, sf_dir, "documents"))


QUERIES = {"op11_passage_dedup": op11_passage_dedup, "op12_periodic_runs": op12_periodic_runs, "op13_collocations": op13_collocations}
