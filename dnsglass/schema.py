"""Event contract, enums and the fixed constants every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
DEFAULT_THRESHOLD = 0.7
# Scale A (threshold step): >= .95 CRITICAL, >= .85 HIGH, >= threshold MEDIUM, else LOW
SCALE_A = (0.95, 0.85)
# Scale B (scoring API / gateway store): >= .9 CRITICAL, >= .7 HIGH, >= .5 MEDIUM, else LOW
SCALE_B = (0.9, 0.7, 0.5)
# Scale C (triage): score >= .95 or correlated >= 5; >= .85 or >= 3; score >= .7; else LOW
SCALE_C = ((0.95, 5), (0.85, 3), 0.7)
MODEL_STATUSES = ["staging", "production", "archived"]
PIPELINE_MODES = ["realtime", "batch"]
MAX_DOMAIN_LEN = 253
DOMAIN_PATTERN = r"^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$"
BENIGN_FAMILY = "alexa"

# Clock of the test tables (events cover 2024-01-01 .. 2024-01-30); only the
# registered queries use it, operators default to the time of the batch.
AS_OF = "2024-01-31 00:00:00"

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("domain", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_dga", T.BooleanType()),
    T.StructField("family", T.StringType()),
    T.StructField("family_confidence", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("acknowledged", T.BooleanType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("rules_applied", T.ArrayType(T.StringType())),
    T.StructField("event_date", T.DateType()),
])

# Raw DNS log message (JSON form).
DNS_MESSAGE_SCHEMA = T.StructType([
    T.StructField("query_name", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("response_size", T.StringType()),
])


def as_of_lit(as_of: str | None = None) -> Column:
    """The given time, or the current one."""
    return (F.lit(as_of) if as_of else F.current_timestamp()).cast("timestamp_ntz")


def severity_rank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c == "CRITICAL", 4).when(c == "HIGH", 3)
            .when(c == "MEDIUM", 2).when(c == "LOW", 1).otherwise(0))


def rank_to_severity(col: Column) -> Column:
    return (F.when(col == 4, "CRITICAL").when(col == 3, "HIGH")
            .when(col == 2, "MEDIUM").when(col == 1, "LOW"))


def severity_scale(scale: str, score: Column | str, threshold: Column | float | None = None,
                   correlated: Column | None = None) -> Column:
    """Named severity scales A, B, C (see module constants)."""
    s = F.col(score) if isinstance(score, str) else score
    if scale == "A":
        t = F.lit(DEFAULT_THRESHOLD) if threshold is None else (
            threshold if isinstance(threshold, Column) else F.lit(threshold))
        return (F.when(s >= SCALE_A[0], "CRITICAL").when(s >= SCALE_A[1], "HIGH")
                .when(s >= t, "MEDIUM").otherwise("LOW"))
    if scale == "B":
        return (F.when(s >= SCALE_B[0], "CRITICAL").when(s >= SCALE_B[1], "HIGH")
                .when(s >= SCALE_B[2], "MEDIUM").otherwise("LOW"))
    if scale == "C":
        n = F.lit(0) if correlated is None else correlated
        (c_s, c_n), (h_s, h_n), m_s = SCALE_C
        return (F.when((s >= c_s) | (n >= c_n), "CRITICAL")
                .when((s >= h_s) | (n >= h_n), "HIGH")
                .when(s >= m_s, "MEDIUM").otherwise("LOW"))
    raise ValueError(f"unknown severity scale {scale!r}")


def r6(c: Column) -> Column:
    """Round a double to 6 decimals (the oracle comparison precision)."""
    return F.round(c, 6)
