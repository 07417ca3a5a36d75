"""Template explanation of alerts (the data part of the explanation step)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import first_label, ratio_extractors, risk_band, shannon_entropy

# Verdict thresholds of the template analysis
DIGIT_RATIO_FLAG = 0.3
LENGTH_FLAG = 15
ENTROPY_FLAG = 3.5


def explain_flags(df: DataFrame) -> DataFrame:
    """machine_generated: digit ratio of the first label > .3 or its length > 15;
    high_entropy: Shannon entropy of the whole domain > 3.5."""
    fl = first_label(F.col("domain"))
    r = ratio_extractors(F.col("domain"))
    return (df.withColumn("first_label", fl)
            .withColumn("digit_ratio", r["digit_ratio"])
            .withColumn("consonant_ratio", r["consonant_ratio"])
            .withColumn("entropy", shannon_entropy(F.col("domain")))
            .withColumn("machine_generated", (F.col("digit_ratio") > DIGIT_RATIO_FLAG) | (F.length(fl) > LENGTH_FLAG))
            .withColumn("high_entropy", F.col("entropy") > ENTROPY_FLAG))


def explain_rows(df: DataFrame) -> DataFrame:
    """Four explanation rows per alert: character, entropy, family, behaviour."""
    f = explain_flags(df)
    fam = F.coalesce(F.col("family"), F.lit("unknown"))
    texts = F.array(
        F.struct(F.lit(0).alias("dim"), F.lit("character").alias("title"), F.format_string(
            "domain '%s': first label length %d, digit ratio %.1f%%, consonant ratio %.1f%%, looks %s",
            F.col("domain"), F.length("first_label"), F.col("digit_ratio") * 100, F.col("consonant_ratio") * 100,
            F.when(F.col("machine_generated"), "machine generated").otherwise("human registered")).alias("text")),
        F.struct(F.lit(1).alias("dim"), F.lit("entropy").alias("title"), F.format_string(
            "Shannon entropy %.2f, %s the benign baseline (2.5-3.5)", F.col("entropy"),
            F.when(F.col("high_entropy"), "above").otherwise("near")).alias("text")),
        F.struct(F.lit(2).alias("dim"), F.lit("family").alias("title"), F.format_string(
            "suspected family %s, score %.4f (%s risk)", fam, F.col("score"), risk_band(F.col("score"))).alias("text")),
        F.struct(F.lit(3).alias("dim"), F.lit("behaviour").alias("title"), F.format_string(
            "source %s queried this domain; check its recent query rate", F.coalesce(F.col("src_ip"), F.lit("")))
            .alias("text")),
    )
    return f.select("*", F.inline(texts))
