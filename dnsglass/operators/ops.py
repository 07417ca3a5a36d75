"""Operations table, run logs and newest-row operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import top_k, top_k_per_group

DETAIL_SCHEMA = T.StructType([T.StructField("feature", T.StringType()),
                              T.StructField("psi", T.DoubleType())])


# --- WIN-2 / WIN-6 / STR-12 ------------------------------------------------------------

def last_n(df: DataFrame, n: int, by: list[str] | None = None, ts: str = "ts",
           tie: str = "event_id") -> DataFrame:
    """Newest n rows (globally: TakeOrderedAndProject; per key: row_number <= n)."""
    order = [F.desc(ts), F.asc(tie)]
    if by:
        return top_k_per_group(df, by, order, n)
    return top_k(df, order, n)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, cols: list[str], tie: str | None = None) -> DataFrame:
    """Newest row per key via max_by (a partial aggregate: no sort, skew-safe)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_v"), F.max(ts).alias(ts))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols], ts)


# --- AGG-19 / AGG-20 -----------------------------------------------------------------------

def decode_detail(col: str = "detail") -> Column:
    """JSON detail -> struct(feature, psi, raw); unparsable -> raw kept."""
    parsed = F.from_json(F.col(col), DETAIL_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.col(col).isNotNull() & F.get_json_object(F.col(col), "$").isNotNull()
    return F.struct(F.when(ok, parsed["feature"]).alias("feature"),
                    F.when(ok, parsed["psi"]).alias("psi"),
                    F.when(~ok, F.col(col)).alias("raw"))


def psi_ranking(ops: DataFrame) -> DataFrame:
    d = ops.where(F.col("operation") == "drift_alert").select(
        F.get_json_object("detail", "$.feature").alias("feature"),
        F.get_json_object("detail", "$.psi").cast("double").alias("psi"))
    return d.where(F.col("feature").isNotNull()).groupBy("feature").agg(F.max("psi").alias("max_psi"))


def operation_stats(ops: DataFrame) -> DataFrame:
    """Counts by status, pending by operation and counts by operation in one
    GROUPING SETS aggregate: rows (dimension, key, count)."""
    x = ops.select("status", "operation",
                   F.when(F.col("status") == "pending", F.col("operation")).alias("pending_operation"))
    g = x.groupingSets([["status"], ["operation"], ["pending_operation"]],
                       "status", "operation", "pending_operation").agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))
    # gid bits (status, operation, pending_operation): 3 -> status, 5 -> operation, 6 -> pending
    dim = (F.when(F.col("gid") == 3, "status").when(F.col("gid") == 5, "operation")
           .otherwise("pending_by_operation"))
    key = F.coalesce("status", "operation", "pending_operation")
    return g.select(dim.alias("dimension"), key.alias("key"), F.col("count").cast("long").alias("count")) \
        .where(F.col("key").isNotNull())


# --- SRT-4 / UPD-2 ---------------------------------------------------------------------------

def list_ops(ops: DataFrame, op_type: str = "pending", limit: int = 50) -> DataFrame:
    d = ops.where(F.col("status") == "pending") if op_type == "pending" else ops
    t = top_k(d, [F.desc("id")], limit)
    return t.select("id", "pipeline_id", "operation", "status", decode_detail("detail").alias("d"),
                    "created_at").select("id", "pipeline_id", "operation", "status", "d.feature", "d.psi",
                                         "d.raw", "created_at")


def transition_ops(ops: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(id, new_status in acknowledged/dismissed) -> outcome per request:
    200 (pending -> new status), 404 (unknown id), 409 (not pending)."""
    o = ops.select(F.col("id").alias("_oid"), F.col("status").alias("old_status"))
    j = requests.join(o, F.col("id") == F.col("_oid"), "left")
    code = (F.when(F.col("_oid").isNull(), 404).when(F.col("old_status") != "pending", 409).otherwise(200))
    return j.select("id", "new_status", "old_status", code.alias("code"))


def apply_transitions(ops: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Next snapshot of the operations table after the successful transitions."""
    ok = outcomes.where(F.col("code") == 200).select(F.col("id").alias("_tid"), "new_status")
    j = ops.join(ok, F.col("id") == F.col("_tid"), "left")
    return j.withColumn("status", F.coalesce("new_status", "status")).drop("_tid", "new_status")


def audit_rows(outcomes: DataFrame, operator: str = "system") -> DataFrame:
    return outcomes.where(F.col("code") == 200).select(
        F.concat(F.lit("operation_"), F.col("new_status")).alias("action"),
        F.col("id").cast("string").alias("resource_id"), F.lit(operator).alias("operator"),
        F.to_json(F.struct("old_status", "new_status")).alias("detail"))


# --- AGG-21 ----------------------------------------------------------------------------------

def agent_metrics(runs: DataFrame, cap: int = 200) -> DataFrame:
    """Per agent over the newest `cap` runs: executions, avg duration, error %."""
    newest = top_k(runs, [F.desc("timestamp"), F.asc("run_id")], cap)
    g = newest.groupBy("agent").agg(
        F.count(F.lit(1)).alias("exec_count"), F.avg("duration_ms").alias("avg"),
        F.count_if(F.col("status") == "error").alias("err"))
    return g.select(F.col("agent").alias("name"), F.col("exec_count").cast("long").alias("exec_count"),
                    F.round("avg", 1).alias("avg_latency"),
                    F.round(F.col("err") / F.col("exec_count") * 100, 1).alias("error_rate"))


# --- JOI-16 ------------------------------------------------------------------------------------

def model_history(audit: DataFrame, model_id: str | None = None) -> DataFrame:
    d = audit.where(F.col("action").like("model_%"))
    if model_id is not None:
        d = d.where(F.col("resource_id") == model_id)
    return d.orderBy(F.desc("created_at"))
