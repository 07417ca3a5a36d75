"""Registered queries that write and read back: the event store, a compiled pipeline with
its sinks, log readers, exports, feedback, the alert chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import chain as CH
from ..operators import correlate as CO
from ..operators import ingest as IN
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources import store as ES
from ..session import ensure_checkpoint_dir
from .catalog import r6, register
from .q_io import _raw_messages
from .spec import pipeline_spec


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


def _scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- SNK-1 / SRC-7 -------------------------------------------------------------------------------

_STORE_SQL = """
SELECT event_id, domain, tenant_id,
  CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN 1.0 WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN round(score / 2, 6) ELSE score END AS score,
  CASE WHEN CAST(event_id AS BIGINT) % 3 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts
FROM dns_events"""


def _store(spark, sf, path):
    """All events, an upsert that moves a third of them to the next day, a compaction, and
    an upsert of a fifth."""
    ev = _ev(spark, sf).select("event_id", "domain", "tenant_id", "score", "ts")
    n = F.col("event_id").cast("long")
    moved = ev.withColumn("ts", F.when(n % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
    SK.write_event_store(ev, path, token="all")
    SK.write_event_store(moved.where(n % 3 == 0).withColumn("score", F.round(F.col("score") / 2, 6)), path, token="thirds")
    SK.write_event_store(ev.limit(10), path, token="thirds")  # a batch that was written before changes nothing
    ES.compact_event_store(spark, path)
    SK.write_event_store(moved.where(n % 5 == 0).withColumn("score", F.lit(1.0)), path)


@register("event_store", f"SELECT *, CAST(ts AS DATE) AS event_date FROM ({_STORE_SQL})")
def event_store(spark, sf):
    path = _scratch(spark, "events")
    _store(spark, sf, path)
    return ES.read_event_store(spark, path).select("event_id", "domain", "tenant_id", "score", "ts", "event_date")


@register("read_events", f"""
SELECT event_id, domain, score, ts FROM ({_STORE_SQL}) WHERE ts >= TIMESTAMP '2024-01-09 06:00:00' AND ts <= TIMESTAMP '2024-01-19 18:30:00'""")
def read_events(spark, sf):
    path = _scratch(spark, "events")
    _store(spark, sf, path)
    return RD.read_events(spark, path, "2024-01-09 06:00:00", "2024-01-19 18:30:00").select("event_id", "domain", "score", "ts")


# --- UDF-1 / SNK-5 / SNK-6 -----------------------------------------------------------------------

_PIPELINE = """
pipeline: {name: dga-realtime-v1, mode: stream, version: "1.0.0"}
nodes:
  - {id: parse, type: dns_parser, config: {fields: [query_name, query_type, src_ip, timestamp]}}
  - {id: feature, type: feature_extractor, config: {extractors: [entropy]}}
  - {id: infer, type: scoring_service, config: {endpoint: "http://scoring:8001", protocol: http, timeout_ms: 3000}}
  - {id: postfilter, type: rule_chain, config: {rules: [{threshold: {default: 0.6, tenants: {finance: 0.3}}}]}}
  - id: sink
    type: multi_sink
    config:
      targets:
        - {type: kafka, topic: alerts, condition: "score >= threshold"}
        - {type: es, index: "events-{date}", condition: always}
        - {type: starrocks, table: severe, condition: high_severity}
conditional_edges:
  - {from: infer, condition: score_threshold, threshold: 0.2, branches: {high: postfilter, low: low_es}}
"""


@register("pipeline_run", """
WITH s AS (SELECT event_id, domain, query_type, src_ip, (length(domain) * 7 + length(src_ip)) % 11 / 10.0 AS score FROM dns_events),
t AS (SELECT *, score >= 0.6 AS is_dga, CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS severity
      FROM s WHERE score >= 0.2)
SELECT 'sink_kafka' AS sink, event_id, domain, query_type, src_ip, round(score, 6) AS score, is_dga, severity FROM t WHERE score >= 0.6
UNION ALL SELECT 'sink_es', event_id, domain, query_type, src_ip, round(score, 6), is_dga, severity FROM t
UNION ALL SELECT 'sink_starrocks', event_id, domain, NULL, src_ip, round(score, 6), is_dga, severity FROM t WHERE severity IN ('CRITICAL', 'HIGH')
UNION ALL SELECT 'low_es', event_id, domain, query_type, src_ip, round(score, 6), false, NULL FROM s WHERE score < 0.2""")
def pipeline_run(spark, sf):
    """A spec with a branch, compiled, run over the raw messages and read back from its sinks."""
    def scorer(df):
        return df.withColumn("score", (F.length("domain") * 7 + F.length("src_ip")) % 11 / 10.0)
    out = _scratch(spark, "pipeline")
    report = pipeline_spec(_PIPELINE, {"scorer": scorer}).write(_raw_messages(spark, sf), out, "b0")
    failed = [r.asDict() for r in report.collect() if not r["ok"]]  # a row for each sink
    if failed:
        raise RuntimeError(f"sinks failed: {failed}")
    cols = ("event_id", "domain", "query_type", "src_ip", "score", "is_dga", "severity")
    kinds = "event_id string, domain string, query_type string, src_ip string, score double, is_dga boolean, severity string"
    kafka = spark.read.schema("key string, value string").json(f"{out}/kafka/alerts").select(F.from_json("value", kinds).alias("v")).select("v.*")
    events = ES.read_event_store(spark, f"{out}/es/events")
    olap = spark.read.parquet(f"{out}/starrocks/severe").withColumn("query_type", F.lit(None).cast("string"))
    low = ES.read_event_store(spark, f"{out}/es/low_es")
    parts = [d.select(F.lit(name).alias("sink"), *cols) for name, d in (("sink_kafka", kafka), ("sink_es", events), ("sink_starrocks", olap), ("low_es", low))]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return rows.withColumn("score", r6(F.col("score")))


# --- SRC-1 / SRC-2 / SRC-4 / SRC-5 / SNK-10 / SNK-13 / STR-12 --------------------------------------

@register("read_logs", """
SELECT domain, src_ip, query_type, CAST(event_id AS BIGINT) % 2 = 0 AS is_json, 'dns' AS source, 'dir' AS read_as FROM dns_events
UNION ALL SELECT domain, src_ip, query_type, CAST(event_id AS BIGINT) % 2 = 0, 'dns', 'path' FROM dns_events""")
def read_logs(spark, sf):
    """Messages written as log lines with blank ones between them, read as a directory and as a path."""
    path = _scratch(spark, "logs")
    lines = _raw_messages(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "raw", F.lit(" ")), F.lit("   "))).alias("value"))
    lines.write.text(path)
    read = {"dir": RD.read_log_dir(spark, path, "*.txt"), "path": RD.read_log_lines(spark, path)}
    parts = [RD.tag_source(IN.parse_dns(d), "dns").select("domain", "src_ip", "query_type", "is_json", "source", F.lit(name).alias("read_as")) for name, d in read.items()]
    return parts[0].union(parts[1])


@register("read_records", """
SELECT 'jsonl' AS fmt, conv_id, turn, role, text FROM conversations
UNION ALL SELECT 'csv', conv_id, turn, role, NULL FROM conversations
UNION ALL SELECT 'parquet', conv_id, turn, role, text FROM conversations""")
def read_records(spark, sf):
    base, rows = _scratch(spark, "records"), fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.json(f"{base}/jsonl/part")
    SK.export_report(rows.drop("text"), f"{base}/csv/part")
    rows.write.parquet(f"{base}/parquet/part")
    parts = []
    for fmt in ("jsonl", "csv", "parquet"):
        schema = rows.schema if fmt != "csv" else rows.drop("text").schema
        d = RD.read_records(spark, f"{base}/{fmt}", fmt, schema, recursive=True)
        parts.append((d if "text" in d.columns else d.withColumn("text", F.lit(None).cast("string"))).select(F.lit(fmt).alias("fmt"), "conv_id", "turn", "role", "text"))
    return parts[0].union(parts[1]).union(parts[2])


@register("append_feedback", """
WITH f AS (SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 11 = 0 THEN NULL ELSE domain END AS domain,
                  CASE WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN 'maybe' ELSE true_label END AS true_label, score FROM feedback_v)
SELECT event_id, domain, true_label, score,
  CASE WHEN domain IS NULL THEN 'no domain' WHEN true_label NOT IN ('dga', 'benign') THEN 'unknown label' END AS reason FROM f""")
def append_feedback(spark, sf):
    """Accepted and rejected labels, as they stand in their tables."""
    base, n = _scratch(spark, "feedback"), F.col("event_id").cast("long")
    rows = fx.feedback_v(spark, sf).withColumn("domain", F.when(n % 11 != 0, F.col("domain"))).withColumn(
        "true_label", F.when(n % 7 == 0, "MAYBE").otherwise(F.col("true_label")))
    SK.append_feedback(rows, f"{base}/kept", f"{base}/rejected")
    kept = spark.read.parquet(f"{base}/kept").withColumn("reason", F.lit(None).cast("string"))
    cols = ("event_id", "domain", "true_label", "score", "reason")
    return kept.select(*cols).union(spark.read.parquet(f"{base}/rejected").select(*cols))


@register("capped_log", "SELECT event_id, ts FROM dns_events ORDER BY ts DESC, event_id LIMIT 500")
def capped_log(spark, sf):
    from ..streaming.stream import capped_log as op
    return op(_ev(spark, sf).select("event_id", "ts"), 500, "ts", "event_id")


# --- STR-8: the batch form of the alert chain ------------------------------------------------------

@register("alert_chain", """
WITH c AS (SELECT a.event_id, a.domain, a.src_ip, a.score, a.is_dga, count(*) AS n FROM dns_events a JOIN dns_events b
             ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTES AND a.ts + INTERVAL 5 MINUTES GROUP BY ALL),
t AS (SELECT *, CASE WHEN score >= 0.95 OR n >= 5 THEN 'CRITICAL' WHEN score >= 0.85 OR n >= 3 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity
      FROM c WHERE is_dga),
ioc AS (SELECT DISTINCT domain AS entry FROM dns_events WHERE length(domain) % 4 = 0),
plan(severity, pos, action) AS (VALUES ('CRITICAL', 0, 'block_dns'), ('CRITICAL', 1, 'isolate_host'),
  ('CRITICAL', 2, 'create_incident'), ('CRITICAL', 3, 'log_event'), ('HIGH', 0, 'block_dns'), ('HIGH', 1, 'isolate_host'),
  ('HIGH', 2, 'log_event'), ('MEDIUM', 0, 'block_dns'), ('MEDIUM', 1, 'log_event'), ('LOW', 0, 'log_event'))
SELECT 'triage' AS output, event_id, severity AS name, CAST(n AS VARCHAR) AS detail FROM t
UNION ALL SELECT 'threat_intel', event_id, CASE WHEN ioc.entry IS NULL THEN 'low' ELSE 'critical' END, CASE WHEN ioc.entry IS NULL THEN '0' ELSE '2' END
  FROM t LEFT JOIN ioc ON ioc.entry = t.domain
UNION ALL SELECT 'explain', event_id, title, NULL FROM t, (VALUES ('character'), ('entropy'), ('family'), ('behaviour')) v(title)
UNION ALL SELECT 'response', event_id, action, CASE action WHEN 'isolate_host' THEN src_ip ELSE domain END FROM t JOIN plan USING (severity)""")
def alert_chain(spark, sf):
    """The four outputs of the alert chain for all alerts, in one table."""
    ev = _ev(spark, sf)
    listed = ev.where(F.length("domain") % 4 == 0).select(F.lit("domain").alias("kind"), F.col("domain").alias("entry")).distinct()
    intel = listed.select("*", F.explode(F.array(F.lit("feed-a"), F.lit("feed-b"))).alias("source"), F.lit("dga").alias("tag"))
    out = CH.alert_chain(CO.triage(ev, 300).where("is_dga"), intel)
    text = F.lit(None).cast("string")
    parts = {"triage": ("severity", F.col("correlated_count").cast("string")), "threat_intel": ("threat_level", F.col("source_count").cast("string")),
             "explain": ("title", text), "response": ("action", F.col("target"))}
    rows = [out[k].select(F.lit(k).alias("output"), "event_id", F.col(name).alias("name"), detail.alias("detail")) for k, (name, detail) in parts.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])
