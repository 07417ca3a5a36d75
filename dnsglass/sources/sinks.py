"""Sinks (SNK-1 .. SNK-13): event store, alert topic, OLAP table, fan-out,
report export, knowledge index, feedback append and batch counters.

The event store takes a batch as a delta of a new version, named by the batch's token, so
that a retried micro-batch or a lost executor never leaves duplicates behind.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.rules import sink_condition
from .store import append_events

log = logging.getLogger(__name__)

CONTRACT_COLS = ["event_id", "trace_id", "ts", "domain", "src_ip", "query_type", "score", "is_dga", "family",
                 "family_confidence", "model_version", "pipeline_id", "tenant_id", "severity", "features",
                 "rules_applied"]


def _cond(df: DataFrame, condition) -> DataFrame:
    if condition is None:
        return df
    c = sink_condition(condition) if isinstance(condition, str) else condition
    return df.where(F.coalesce(c, F.lit(False)))


def with_event_date(df: DataFrame) -> DataFrame:
    return df if "event_date" in df.columns else df.withColumn("event_date", F.to_date("ts"))


def date_suffix(ts, pattern: str = "daily") -> Column:
    """SCA-18 / SNK-1 index suffix: daily yyyy.MM.dd, monthly yyyy.MM, none ''."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if pattern == "daily":
        return F.date_format(c, "yyyy.MM.dd")
    if pattern == "monthly":
        return F.date_format(c, "yyyy.MM")
    return F.lit("")


# Index column of the event store for each date pattern.
_INDEX = {"daily": "event_date", "monthly": "event_month", "none": "event_all"}


def with_index(df: DataFrame, date_pattern: str = "daily") -> DataFrame:
    """Adds the store's index column: the day, the month (yyyy.MM), or one constant."""
    if date_pattern not in _INDEX:
        raise ValueError(f"date pattern {date_pattern!r}: one of {sorted(_INDEX)}")
    if date_pattern == "daily":
        return with_event_date(df)
    return df.withColumn(_INDEX[date_pattern], date_suffix("ts", "monthly") if date_pattern == "monthly" else F.lit("all"))


def write_event_store(df: DataFrame, path: str, condition: str | None = "always", date_pattern: str = "daily",
                      files: int = 8, token: str | None = None) -> int:
    """SNK-1: upsert by event_id into the versioned store (see `store`) at `path`; the number of
    the new version.  A new row wins over a stored one with its id; of two new ones the
    later (ts) wins, then the larger by its columns.  The batch is added as a delta, no
    stored file is touched, and with the same `token` a retried batch changes nothing."""
    return append_events(with_index(_cond(df, condition), date_pattern), path, _INDEX[date_pattern], files, token)


#: Times in messages keep their microseconds.
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}


def alert_messages(df: DataFrame, key: str = "domain", condition: str | None = "is_dga") -> DataFrame:
    """SNK-2 payload: (key, value = JSON of the event contract)."""
    d = _cond(df, condition)
    cols = [c for c in CONTRACT_COLS if c in d.columns]
    return d.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*cols), JSON_TIMES).alias("value"))


def write_alert_topic(df: DataFrame, target: str, key: str = "domain", condition: str | None = "is_dga",
                      fmt: str = "json", options: dict | None = None) -> None:
    """SNK-2: keyed JSON messages to Kafka (`fmt='kafka'`, target = topic) or files."""
    msgs = alert_messages(df, key, condition)
    if fmt == "kafka":
        msgs.write.format("kafka").option("topic", target).options(**(options or {})).save()
    else:
        msgs.write.mode("append").json(target)


def olap_projection(df: DataFrame) -> DataFrame:
    """SNK-3 row normalisation: family null -> '', confidence null -> 0.0,
    time at second resolution."""
    return df.select(
        "event_id", "trace_id", F.date_trunc("second", F.col("ts")).alias("event_time"), "domain", "src_ip",
        "score", "is_dga", F.coalesce("family", F.lit("")).alias("family"),
        F.coalesce("family_confidence", F.lit(0.0)).alias("family_confidence"),
        "model_version", "pipeline_id", "tenant_id", "severity", F.to_date("ts").alias("event_date"))


def write_olap_table(df: DataFrame, path: str, condition: str | None = "is_dga") -> None:
    olap_projection(_cond(df, condition)).write.mode("append").partitionBy("event_date").parquet(path)


def fan_out(df: DataFrame, targets: list[tuple[str, str | None, object]], on_error: str = "continue") -> DataFrame:
    """SNK-5 / SNK-6: one input, several sinks, each with its own condition.
    `targets` = [(name, condition, writer(df))].  The input is persisted once; the rows that a
    sink takes are counted while they are written (`observe`), by no job of its own.
    A sink that fails is recorded and the others go on, or with on_error="abort" the
    error is raised.  Returns (sink, ok, error, rows), the first entry of each name."""
    spark = df.sparkSession
    df = df.persist()
    report = []
    try:
        for name, condition, writer in targets:
            seen = Observation()
            part = _cond(df, condition).observe(seen, F.count(F.lit(1)).alias("rows"))
            try:
                written = writer(part)  # False: the sink has this batch already, nothing was read
                report.append((name, True, None, 0 if written is False else seen.get["rows"]))
            except Exception as e:  # noqa: BLE001
                report.append((name, False, str(e), 0))
                if on_error == "abort":
                    raise
    finally:
        df.unpersist()
    first: dict[str, tuple] = {}
    for r in report:  # distinct sink names (Q11)
        first.setdefault(r[0], r)
    return spark.createDataFrame(list(first.values()), "sink string, ok boolean, error string, rows long")


def export_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK-10: header + rows as CSV, or JSON lines."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").json(path)


def write_knowledge_index(chunks: DataFrame, path: str) -> None:
    """SNK-11: chunk + embedding + nested metadata rows, appended."""
    cols = chunks.columns
    meta = [c for c in ("source", "category", "title", "chunk_id") if c in cols]
    out = chunks.select(*[c for c in cols if c not in meta], F.struct(*meta).alias("metadata"))
    out.write.mode("append").parquet(path)


def batch_run_stats(df: DataFrame) -> DataFrame:
    """SNK-12: {total, alerts, errors, files} of a batch run in one aggregate."""
    errs = F.coalesce(F.size("errors"), F.lit(0)) > 0 if "errors" in df.columns else F.lit(False)
    files = F.count_distinct("file_path") if "file_path" in df.columns else F.lit(1)
    return df.agg(F.count(F.lit(1)).cast("long").alias("total"),
                  F.count_if(F.col("is_dga") == F.lit(True)).cast("long").alias("alerts"),
                  F.count_if(errs).cast("long").alias("errors"), files.cast("long").alias("files"))


def split_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyst labels with defaults as (accepted, rejected); a label other than dga /
    benign, or a missing domain, is rejected with a `reason`."""
    out = df.select(
        F.coalesce("event_id", F.lit("")).alias("event_id"), F.col("domain"),
        F.lower(F.col("true_label")).alias("true_label"),
        F.coalesce(F.lower(F.col("predicted_label")), F.lit("dga")).alias("predicted_label"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.col("family"),
        F.coalesce("annotator", F.lit("analyst")).alias("annotator"),
        F.coalesce("created_at", F.current_timestamp().cast("timestamp_ntz")).alias("created_at"))
    reason = F.when(F.col("domain").isNull(), "no domain").when(
        ~F.coalesce(F.col("true_label").isin("dga", "benign"), F.lit(False)), "unknown label")
    out = out.withColumn("reason", reason)
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def append_feedback(df: DataFrame, path: str | None = None, rejects_path: str | None = None) -> DataFrame:
    """SNK-13: appends the accepted labels to `path` and the rejected ones, with the
    reason, to `rejects_path`; returns the accepted ones."""
    accepted, rejected = split_feedback(df)
    if path:
        accepted.write.mode("append").parquet(path)
    if rejects_path:
        rejected.write.mode("append").parquet(rejects_path)
    return accepted
