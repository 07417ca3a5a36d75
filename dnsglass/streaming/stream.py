"""Structured Streaming forms of the dataflow (STR-1 .. STR-12).

A stream is `readStream -> chain of DataFrame transforms -> writeStream`
with a checkpoint location: offsets, state and sink commits are recovered by
Spark after a failure (exactly-once per offset with idempotent sinks).
Event time is a TIMESTAMP column (watermarks reject TIMESTAMP_NTZ).
"""

from __future__ import annotations

import datetime as _dt
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import chain as CH
from ..operators import drift as DR
from ..operators import feedback as FB
from ..operators.ops import last_n
from ..session import path_exists
from ..sources.versions import current_version, next_version

log = logging.getLogger(__name__)

Transform = Callable[[DataFrame], DataFrame]


def chain(*steps: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df
    return run


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Cast the event-time column to TIMESTAMP (session time zone UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# --- STR-1 / STR-2 ------------------------------------------------------------------------

def run_stream(source: DataFrame, transform: Transform, sink: Callable[[DataFrame, int], None],
               checkpoint: str, trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Each message through the chain once per offset; sinks run in
    `foreachBatch` (they can persist the batch once and fan out).  The
    checkpoint location holds offsets and state: a restart resumes there."""
    out = transform(source)
    w = out.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


@contextmanager
def stateful_settings(spark: SparkSession) -> Iterator[None]:
    """What a query with `score_cache_stream` or `tag_late` needs of the session while it is
    started: the RocksDB state store, and no batches without data, as with
    processing-time state those would go on for ever under `availableNow`.  A query keeps
    the settings that it was started with; the session gets its own back."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


# --- STR-3 / STR-10 --------------------------------------------------------------------------

def dedupe_stream(df: DataFrame, key: str = "event_id", delay: str = "24 hours", ts: str = "ts") -> DataFrame:
    """Processed-marker with a TTL: duplicates of a key inside the watermark
    horizon are dropped; state is evicted after it."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class _LateRows(StatefulProcessor):
    """Marks the rows older than the watermark that held when their batch began."""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        for part in rows:
            yield part.drop(columns="_slot", errors="ignore").assign(late=part[self.ts] < mark)

    def close(self) -> None:
        pass


def tag_late(df: DataFrame, delay: str, ts: str = "ts", slots: int = 64) -> DataFrame:
    """STR-10: the stream's rows with `late`: older than the event-time watermark (newest
    time seen in earlier batches less `delay`, kept in the checkpoint).  Late rows stay in
    the stream, none is dropped.  Rows are dealt over `slots` by their hash, so no key
    matters.  A row without time is never late.  See `stateful_settings`."""
    schema = df.withColumn("late", F.lit(True)).schema
    dealt = df.withWatermark(ts, delay).withColumn("_slot", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
    return dealt.groupBy("_slot").transformWithStateInPandas(_LateRows(ts), schema, "append", "processingTime")


def late_data_sink(on_time_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for `tag_late`: rows on time and late rows go to folders of the
    epoch of their own, so that a retried epoch writes the same folders again."""
    def body(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for path, keep in ((on_time_path, ~F.col("late")), (quarantine_path, F.col("late"))):
                batch.where(keep).drop("late").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        finally:
            batch.unpersist()
    return body


def late_data_policy(source: DataFrame, on_time_path: str, quarantine_path: str, checkpoint: str, delay: str = "10 minutes",
                     ts: str = "ts", trigger: dict | None = None) -> StreamingQuery:
    """STR-10 as a query: late rows to the quarantine table, all others to the main one."""
    with stateful_settings(source.sparkSession):
        return run_stream(source, lambda d: tag_late(d, delay, ts), late_data_sink(on_time_path, quarantine_path), checkpoint, trigger)


# --- STR-4 --------------------------------------------------------------------------------------

def _replay_bounds(date: str, hour: int | None) -> tuple[str, str]:
    start = f"{date} {hour:02d}:00:00" if hour is not None else f"{date} 00:00:00"
    end = f"{date} {hour:02d}:59:59.999999" if hour is not None else f"{date} 23:59:59.999999"
    return start, end


def replay_frame(events: DataFrame, date: str, transform: Transform, hour: int | None = None) -> DataFrame:
    """One day (or hour) of stored events through the chain; the day bound is
    also an `event_date` predicate so only that partition is scanned."""
    start, end = _replay_bounds(date, hour)
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    d = events.where((F.col("ts") >= s) & (F.col("ts") <= e))
    if "event_date" in events.columns:
        d = d.where(F.col("event_date") == F.lit(date).cast("date"))
    out = transform(d)
    return out if "event_date" in out.columns else out.withColumn("event_date", F.to_date("ts"))


def replay(spark, events_path: str, date: str, transform: Transform, out_path: str, hour: int | None = None) -> None:
    """Re-run one day (or hour) of stored history through the same chain and
    overwrite only that day's output partition."""
    df = replay_frame(spark.read.parquet(events_path), date, transform, hour)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date")
     .parquet(out_path))


# --- STR-5 / STR-9 ---------------------------------------------------------------------------------

def nxdomain_stream(df: DataFrame, window_sec: int = 60, key: str = "src_ip", mode: str = "session",
                    delay: str = "10 minutes") -> DataFrame:
    """Per-source NXDOMAIN counters.  mode='session': expiry refreshed by each
    query (gap 2 x window, the counter semantics); mode='sliding': a window of
    2 x window sliding by window (the documented intent)."""
    d = df.withWatermark("ts", delay)
    if mode == "session":
        w = F.session_window("ts", f"{2 * window_sec} seconds")
    else:
        w = F.window("ts", f"{2 * window_sec} seconds", f"{window_sec} seconds")
    g = d.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("total"),
                                                F.count_if(F.col("is_nx") == F.lit(True)).alias("nx"))
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "nx",
                    (F.col("nx") / F.greatest(F.col("total"), F.lit(1))).alias("nx_ratio"))


def windowed_counts(df: DataFrame, kind: str = "tumbling", size: str = "1 minute", slide: str | None = None,
                    gap: str | None = None, key: str = "src_ip", delay: str | None = None) -> DataFrame:
    """STR-9: tumbling / sliding / session counts and DGA hits per key
    (batch or stream; pass `delay` to bound state in a stream)."""
    d = df.withWatermark("ts", delay) if delay else df
    if kind == "session":
        w = F.session_window("ts", gap or size)
    elif kind == "sliding":
        w = F.window("ts", size, slide)
    else:
        w = F.window("ts", size)
    g = d.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("count"),
                                                F.count_if(F.col("is_dga") == F.lit(True)).alias("hits"))
    return g.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.col("count").cast("long").alias("count"), F.col("hits").cast("long").alias("hits"))


# --- STR-6 / STR-7 --------------------------------------------------------------------------------------

def _query_id(spark: SparkSession) -> str:
    """The id of the streaming query whose batch is at hand: it lasts as long as its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def drift_monitor_batch(window_size: int = 1000, baseline: DataFrame | None = None,
                        features=("score", "domain_len"), ops_path: str | None = None,
                        as_of: str | None = None, window_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the newest `window_size` samples of the stream -> PSI against
    the baseline (needs >= 100) -> ALERT rows in the operations table (6 h cooldown
    per feature, relative to the batch time).

    With `window_path` the window lasts across batches, restarts and new checkpoints:
    each batch publishes the newest samples of the window before it and its own as the
    table's next version.  A retried batch finds its version and writes nothing twice;
    old versions are removed."""
    def body(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        query = _query_id(spark)
        now = as_of or _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        cur = batch
        if window_path:
            def window(before: DataFrame | None) -> DataFrame:
                both = batch if before is None else batch.unionByName(before, allowMissingColumns=True)
                return last_n(both, window_size)
            next_version(spark, window_path, window, f"{query}/{epoch}")
            cur = current_version(spark, window_path)
        else:
            cur = last_n(cur, window_size)
        scores = DR.psi(baseline, cur, list(features))
        ops = None
        if ops_path and path_exists(spark, ops_path):
            ops = spark.read.parquet(ops_path)
            if "batch" in ops.columns:
                ops = ops.where(F.coalesce(F.col("batch"), F.lit("")) != f"{query or 'none'}-{epoch}").drop("batch")
        alerts = DR.drift_alerts(scores, ops, now).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
        if ops_path:
            alerts = spark.createDataFrame(alerts.collect(), alerts.schema)  # one row a feature; read before it is written
            alerts.write.mode("overwrite").parquet(f"{ops_path}/batch={query or 'none'}-{epoch}")
    return body


def current_lists(spark, lists_path: str) -> DataFrame | None:
    """The lists of the version that the pointer names; None before the first one."""
    return current_version(spark, lists_path)


def feedback_refresh_batch(lists_path: str, feedback_path: str, audit_path: str | None = None,
                           as_of=None) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: re-aggregate the look-back window of all feedback into the next
    version of the lists, and append its differences as audit rows.  Readers
    (`current_lists`) see the old lists or the new ones, never a mixture; versions only
    grow, also when the query starts over with a new checkpoint and its epochs at 0.  A
    retried batch keeps the version and rewrites the audit folder it made before."""
    def body(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        now = as_of or _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        version = next_version(spark, lists_path, lambda before: FB.promote_lists(spark.read.parquet(feedback_path), now),
                               f"{_query_id(spark)}/{epoch}")
        if audit_path:
            new = current_version(spark, lists_path, version)
            old = current_version(spark, lists_path, version - 1)
            FB.list_diff(new, new.limit(0) if old is None else old).write.mode("overwrite").parquet(f"{audit_path}/version={version}")
    return body


# --- STR-8 ------------------------------------------------------------------------------------------------

def triage_stream(alerts: DataFrame, events: DataFrame, window_sec: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Every alert joined with the same-source events within ±window
    (stream-stream interval join, watermarks on both sides), counted, then
    the triage severity scale C and its confidence.  The alert's domain and family
    come along where it has them."""
    more = [c for c in ("domain", "family") if c in alerts.columns]
    a = alerts.withWatermark("ts", delay).select(F.col("event_id").alias("alert_id"), F.col("src_ip").alias("a_ip"),
                                                  F.col("ts").alias("a_ts"), F.col("score").alias("a_score"), *more)
    e = events.withWatermark("ts", delay).select(F.col("src_ip").alias("e_ip"), F.col("ts").alias("e_ts"))
    j = a.join(e, (F.col("a_ip") == F.col("e_ip"))
               & F.col("e_ts").between(F.col("a_ts") - F.expr(f"INTERVAL {window_sec} SECONDS"),
                                       F.col("a_ts") + F.expr(f"INTERVAL {window_sec} SECONDS")), "leftOuter")
    # a_ts keeps the alert side's event-time watermark through the join
    g = j.groupBy("alert_id", "a_ip", "a_ts", "a_score", *more).agg(F.count("e_ts").alias("correlated_count"))
    return CH.with_severity(g, "a_score")


def triage_sink(out_path: str, intel_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for `triage_stream`: the chain's four outputs (triage,
    threat_intel, explain, response), each in a folder of the epoch.  Indicators are the
    current version of the table at `intel_path` (kind domain / ip, entry, source, tag), read
    anew in each batch; before its first version nothing is listed."""
    def body(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        intel = current_version(spark, intel_path)
        if intel is None:
            intel = spark.createDataFrame([], "kind string, entry string, source string, tag string")
        triaged = batch.withColumnsRenamed({"alert_id": "event_id", "a_ip": "src_ip", "a_ts": "ts", "a_score": "score"}).persist()
        try:
            for name, rows in CH.alert_chain(triaged, intel).items():
                rows.write.mode("overwrite").parquet(f"{out_path}/{name}/epoch={epoch}")
        finally:
            triaged.unpersist()
    return body


# --- STR-11 ----------------------------------------------------------------------------------------------

class _ScoreCache(StatefulProcessor):
    """One score per key, forgotten `ttl_ms` after it was worked out."""

    def __init__(self, key: str, scorer: Callable[[pd.Series], pd.Series], ttl_ms: int):
        self.key, self.scorer, self.ttl_ms = key, scorer, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", "score double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.score.get()
        cached = kept is not None
        score = kept[0] if cached else float(self.scorer(pd.Series([key[0]])).iloc[0])
        if not cached:
            self.score.update((score,))
        for part in rows:  # a hot key's rows go through in pieces
            yield part.assign(score=score, cached=cached)

    def close(self) -> None:
        pass


def score_cache_stream(df: DataFrame, scorer: Callable[[pd.Series], pd.Series], ttl_seconds: int = 300,
                       key: str = "domain") -> DataFrame:
    """The stream's rows with `score` and `cached`: a key is scored once and keeps its
    score for `ttl_seconds` (processing time, as state with a time to live that survives
    restarts); after that the next row scores it anew.  All rows of a batch get the same
    answer.  A null key is a key like any other.  See `stateful_settings`."""
    schema = df.withColumn("score", F.lit(0.0)).withColumn("cached", F.lit(True)).schema
    return df.groupBy(key).transformWithStateInPandas(_ScoreCache(key, scorer, ttl_seconds * 1000), schema, "append", "processingTime")


# --- STR-12 -----------------------------------------------------------------------------------------------

def capped_log(log_df: DataFrame, n: int, ts: str = "timestamp", tie: str = "run_id") -> DataFrame:
    """Newest n entries of an append-only log, newest first."""
    return last_n(log_df, n, ts=ts, tie=tie)
