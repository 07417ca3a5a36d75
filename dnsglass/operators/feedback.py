"""Analyst-feedback loop: per-domain FP/TP counts, auto allow/deny list
promotion, list diffs (audit rows), per-family FP-rate recommendations and the
cooldown anti-join shared with drift alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import as_of_lit

# Fixed values (must equal the reference)
LOOKBACK_DAYS = 30
FP_PROMOTE_THRESHOLD = 5
TP_PROMOTE_THRESHOLD = 3
MIN_SAMPLES_PER_FAMILY = 20
FP_RATE_THRESHOLD = 0.20
RECOMMENDATION_COOLDOWN_DAYS = 7
WL_KEY = "whitelist:auto"
BL_KEY = "blacklist:auto"


def _recent(fb: DataFrame, as_of=None, days: int = LOOKBACK_DAYS) -> DataFrame:
    return fb.where(F.col("created_at") > as_of_lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def feedback_by_domain(fb: DataFrame, as_of=None, days: int = LOOKBACK_DAYS) -> DataFrame:
    d = _recent(fb, as_of, days).where(F.col("domain").isNotNull())
    return d.groupBy("domain").agg(
        F.count_if(F.col("true_label") == "benign").cast("long").alias("fp_count"),
        F.count_if(F.col("true_label") == "dga").cast("long").alias("tp_count"))


def promote_lists(fb: DataFrame, as_of=None) -> DataFrame:
    """New full contents of the auto lists: (list_name, entry)."""
    c = feedback_by_domain(fb, as_of)
    name = (F.when((F.col("fp_count") >= FP_PROMOTE_THRESHOLD) & (F.col("tp_count") == 0), F.lit(WL_KEY))
            .when((F.col("tp_count") >= TP_PROMOTE_THRESHOLD) & (F.col("fp_count") == 0), F.lit(BL_KEY)))
    return c.select(name.alias("list_name"), F.col("domain").alias("entry")).where(F.col("list_name").isNotNull())


def list_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Audit rows for added (promote) and removed (demote) entries per list,
    as two anti joins on (list_name, entry)."""
    n = new.select("list_name", "entry").distinct()
    o = old.select("list_name", "entry").distinct()
    added = n.join(o, ["list_name", "entry"], "left_anti").withColumn("change", F.lit("promote"))
    removed = o.join(n, ["list_name", "entry"], "left_anti").withColumn("change", F.lit("demote"))
    out = added.unionByName(removed)
    kind = F.when(F.col("list_name") == WL_KEY, "whitelist").otherwise("blacklist")
    reason = (F.when(F.col("change") == "demote", F.lit("signal aged out of window"))
              .when(F.col("list_name") == WL_KEY,
                    F.lit(f"≥{FP_PROMOTE_THRESHOLD} FP & 0 TP in {LOOKBACK_DAYS}d"))
              .otherwise(F.lit(f"≥{TP_PROMOTE_THRESHOLD} TP & 0 FP in {LOOKBACK_DAYS}d")))
    return out.select(F.lit("feedback-aggregator").alias("user_id"),
                      F.concat(F.lit("auto_"), kind, F.lit("_"), F.col("change")).alias("action"),
                      F.col("entry").alias("resource"),
                      F.to_json(F.struct(reason.alias("reason"))).alias("detail"))


def except_lists(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-2: (new - old, old - new) as set differences."""
    return new.subtract(old), old.subtract(new)


def cooldown(new_ops: DataFrame, ops: DataFrame, key_col: str, json_key: str, operation: str,
             interval: str, as_of=None) -> DataFrame:
    """Suppress candidates whose key already has a pending `operation` created
    within `interval` before as_of (left anti join on key + time predicate)."""
    recent = ops.where((F.col("operation") == operation) & (F.col("status") == "pending")
                       & (F.col("created_at") > as_of_lit(as_of) - F.expr(f"INTERVAL {interval}")))
    keys = recent.select(F.get_json_object("detail", f"$.{json_key}").alias("_ck")).where(F.col("_ck").isNotNull())
    return new_ops.join(keys, F.col(key_col) == F.col("_ck"), "left_anti")


def family_fp_rate(fb: DataFrame, ops: DataFrame | None = None, as_of=None) -> DataFrame:
    """Families with n >= 20 and FP rate > .20 in the look-back -> pending
    threshold_recommendation rows (JSON detail), minus those in cooldown."""
    d = _recent(fb, as_of).where(F.col("family").isNotNull() & (F.col("family") != ""))
    g = d.groupBy("family").agg(
        F.count(F.lit(1)).cast("long").alias("n_samples"),
        F.count_if(F.col("true_label") == "benign").cast("long").alias("fp_count"),
        F.count_if(F.col("true_label") == "dga").cast("long").alias("tp_count"))
    g = g.where(F.col("n_samples") >= MIN_SAMPLES_PER_FAMILY)
    g = g.withColumn("fp_rate", F.col("fp_count") / F.col("n_samples")).where(F.col("fp_rate") > FP_RATE_THRESHOLD)
    if ops is not None:
        g = cooldown(g, ops, "family", "family", "threshold_recommendation",
                     f"{RECOMMENDATION_COOLDOWN_DAYS} DAYS", as_of)
    detail = F.to_json(F.struct("family", F.round("fp_rate", 3).alias("fp_rate"), "n_samples", "fp_count", "tp_count"))
    return g.select(F.lit("default").alias("pipeline_id"), F.lit("threshold_recommendation").alias("operation"),
                    F.lit("feedback-aggregator").alias("operator"), F.lit("pending").alias("status"),
                    "family", F.round("fp_rate", 3).alias("fp_rate"), "n_samples", "fp_count", "tp_count",
                    detail.alias("detail"))
