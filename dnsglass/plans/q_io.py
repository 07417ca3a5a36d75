"""Registered queries: parsing, contract validation, sink projections, set
operators, the score cache, time helpers, replay, windowed counts, the
config-driven pipeline and a Structured Streaming run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.timeutil import relative_range
from ..operators import ingest as IN
from ..sources import readers as RD
from ..sources import sinks as SK
from ..streaming import stream as ST
from .catalog import r6, register
from .q_rules import _entropy_sql

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


def _raw_messages(spark, sf):
    """DNS log lines in the two wire forms: JSON objects (even ids) and
    whitespace text `name type ip` (odd ids)."""
    ev = _ev(spark, sf)
    js = F.to_json(F.struct(F.col("domain").alias("query_name"), F.col("src_ip"), F.col("query_type"),
                            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    txt = F.concat_ws(" ", "domain", "query_type", "src_ip")
    return ev.select("event_id", F.when(F.col("event_id").cast("long") % 2 == 0, js).otherwise(txt).alias("raw"))


_RAW_SQL = """raw AS (SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN
    json_object('query_name', domain, 'src_ip', src_ip, 'query_type', query_type,
                'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'))::VARCHAR
  ELSE concat_ws(' ', domain, query_type, src_ip) END AS raw FROM dns_events)"""


@register("parse_dns", f"""WITH {_RAW_SQL},
p AS (SELECT event_id, raw, starts_with(trim(raw), '{{') AS is_obj, string_split_regex(trim(raw), '\\s+') AS parts FROM raw)
SELECT event_id,
  CASE WHEN is_obj THEN coalesce(json_extract_string(raw, '$.query_name'), '') ELSE coalesce(parts[1], '') END AS domain,
  CASE WHEN is_obj THEN coalesce(json_extract_string(raw, '$.src_ip'), '') ELSE coalesce(parts[3], '') END AS src_ip,
  CASE WHEN is_obj THEN coalesce(json_extract_string(raw, '$.query_type'), '') ELSE coalesce(parts[2], '') END AS query_type,
  CASE WHEN is_obj THEN coalesce(json_extract_string(raw, '$.timestamp'), '') ELSE coalesce(parts[4], '') END AS event_timestamp
FROM p""")
def parse_dns(spark, sf):
    out = IN.parse_dns(_raw_messages(spark, sf))
    return out.select("event_id", "domain", "src_ip", "query_type", "event_timestamp")


@register("parse_dns_partial_fields", f"""WITH {_RAW_SQL},
p AS (SELECT event_id, raw, starts_with(trim(raw), '{{') AS is_obj, string_split_regex(trim(raw), '\\s+') AS parts FROM raw)
SELECT event_id,
  CASE WHEN is_obj THEN coalesce(json_extract_string(raw, '$.query_name'), '') ELSE coalesce(parts[1], '') END AS domain,
  '' AS src_ip, 'A' AS query_type, '' AS event_timestamp
FROM p""")
def parse_dns_partial_fields(spark, sf):
    out = IN.parse_dns(_raw_messages(spark, sf), fields=["query_name"])
    return out.select("event_id", "domain", "src_ip", "query_type", "event_timestamp")


_CONTRACT_SQL = """msgs AS (SELECT event_id, CASE
    WHEN CAST(event_id AS BIGINT) % 7 = 0 THEN substr(j, 1, 20)
    ELSE j END AS value FROM (SELECT event_id, json_object('event_id', event_id, 'trace_id', trace_id,
      'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'domain', CASE WHEN CAST(event_id AS BIGINT) % 11 = 0 THEN '' ELSE domain END,
      'src_ip', src_ip, 'score', score, 'is_dga', is_dga, 'severity', severity)::VARCHAR AS j FROM dns_events))"""


def _contract_msgs(spark, sf):
    ev = _ev(spark, sf)
    dom = F.when(F.col("event_id").cast("long") % 11 == 0, F.lit("")).otherwise(F.col("domain"))
    j = F.to_json(F.struct("event_id", "trace_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                           dom.alias("domain"), "src_ip", "score", "is_dga", "severity"))
    return ev.select("event_id", F.when(F.col("event_id").cast("long") % 7 == 0, F.substring(j, 1, 20))
                     .otherwise(j).alias("value"))


@register("validate_event_contract", f"""WITH {_CONTRACT_SQL}
SELECT json_extract_string(value, '$.event_id') AS event_id, json_extract_string(value, '$.domain') AS domain,
       CAST(json_extract_string(value, '$.score') AS DOUBLE) AS score
FROM msgs WHERE json_valid(value) AND length(trim(coalesce(json_extract_string(value, '$.domain'), ''))) > 0""")
def validate_event_contract(spark, sf):
    valid, _ = IN.validate_event_contract(_contract_msgs(spark, sf))
    return valid.select("event_id", "domain", "score")


@register("quarantine_event_contract", f"""WITH {_CONTRACT_SQL}
SELECT value FROM msgs WHERE NOT json_valid(value) OR length(trim(coalesce(json_extract_string(value, '$.domain'), ''))) = 0""")
def quarantine_event_contract(spark, sf):
    _, q = IN.validate_event_contract(_contract_msgs(spark, sf))
    return q


@register("olap_projection", """
SELECT event_id, trace_id, date_trunc('second', ts) AS event_time, domain, src_ip, score, is_dga,
       coalesce(family, '') AS family, coalesce(family_confidence, 0.0) AS family_confidence, model_version,
       pipeline_id, tenant_id, severity, CAST(ts AS DATE) AS event_date
FROM dns_events WHERE is_dga""")
def olap_projection(spark, sf):
    return SK.olap_projection(_ev(spark, sf).where("is_dga"))


_CONTRACT_PART = [c for c in SK.CONTRACT_COLS if c not in ("features", "rules_applied")]  # what stored events have


@register("alert_messages", f"SELECT domain AS key, {', '.join(_CONTRACT_PART)} FROM dns_events WHERE is_dga")
def alert_messages(spark, sf):
    """The messages' JSON, parsed back: all fields of the payload."""
    ev = _ev(spark, sf)
    m = SK.alert_messages(ev, "domain", "is_dga")
    fields = ", ".join(f"{c} {ev.schema[c].dataType.simpleString()}" for c in _CONTRACT_PART)
    return m.select("key", F.from_json("value", fields, SK.JSON_TIMES).alias("v")).select("key", "v.*")


@register("batch_run_stats", """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_dga) AS BIGINT) AS alerts,
       CAST(0 AS BIGINT) AS errors, CAST(count(DISTINCT event_date) AS BIGINT) AS files FROM dns_events""")
def batch_run_stats(spark, sf):
    ev = _ev(spark, sf).withColumn("file_path", F.concat(F.lit("day-"), F.col("event_date").cast("string")))
    return SK.batch_run_stats(ev)


@register("dedupe_events", """
SELECT DISTINCT event_id, domain, ts FROM dns_events""")
def dedupe_events(spark, sf):
    ev = _ev(spark, sf).select("event_id", "domain", "ts")
    dup = ev.unionByName(ev.where(F.col("event_id").cast("long") % 3 == 0))
    return IN.dedupe_events(dup)


@register("merge_scored", """
SELECT event_id, score, true AS cached FROM dns_events WHERE CAST(event_id AS BIGINT) % 2 = 0
UNION ALL SELECT event_id, score, false FROM dns_events WHERE CAST(event_id AS BIGINT) % 2 = 1""")
def merge_scored(spark, sf):
    ev = _ev(spark, sf).select("event_id", "score")
    return IN.merge_scored(ev.where(F.col("event_id").cast("long") % 2 == 0),
                           ev.where(F.col("event_id").cast("long") % 2 == 1))


@register("score_distinct", f"""
WITH cache AS (SELECT 'score:' || substr(sha256(domain), 1, 16) AS cache_key, 0.5 AS score,
                      {AS_OF} - INTERVAL 100 SECONDS AS cached_at FROM (SELECT DISTINCT domain FROM dns_events WHERE domain LIKE 'blog.%')
               UNION ALL SELECT 'score:' || substr(sha256(domain), 1, 16), 0.25, {AS_OF} - INTERVAL 900 SECONDS
               FROM (SELECT DISTINCT domain FROM dns_events WHERE domain LIKE 'www.%')),
k AS (SELECT DISTINCT domain, 'score:' || substr(sha256(domain), 1, 16) AS cache_key FROM dns_events),
fresh AS (SELECT cache_key, arg_max(score, cached_at) AS score FROM cache WHERE cached_at > {AS_OF} - INTERVAL 300 SECONDS GROUP BY 1),
s AS (SELECT k.domain, f.score, true AS cached FROM k JOIN fresh f USING (cache_key)
      UNION ALL SELECT k.domain, round(length(k.domain) / 253.0, 6), false FROM k WHERE cache_key NOT IN (SELECT cache_key FROM fresh))
SELECT e.event_id, s.score, s.cached FROM dns_events e LEFT JOIN s USING (domain)""")
def score_distinct(spark, sf):
    ev = _ev(spark, sf)
    doms = ev.select("domain").distinct()
    from ..functions.domain import cache_key
    cache = (doms.where(F.col("domain").startswith("blog.")).select(
        cache_key(F.col("domain")).alias("cache_key"), F.lit(0.5).alias("score"),
        (F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 100 SECONDS")).alias("cached_at"))
        .unionByName(doms.where(F.col("domain").startswith("www.")).select(
            cache_key(F.col("domain")).alias("cache_key"), F.lit(0.25).alias("score"),
            (F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 900 SECONDS")).alias("cached_at"))))

    def scorer(d):
        return d.select("domain", F.round(F.length("domain") / 253.0, 6).alias("score"))
    out = IN.score_distinct(ev.select("event_id", "domain"), scorer, cache, now="2024-01-31 00:00:00")
    return out.select("event_id", "score", "cached")


@register("date_suffix", """
SELECT event_id, strftime(ts, '%Y.%m.%d') AS daily, strftime(ts, '%Y.%m') AS monthly,
       strftime(ts, '%H:%M') AS hm, strftime(ts, '%H:00') AS h00, strftime(ts, '%m-%d %H:00') AS mdh,
       strftime(ts, '%Y-%m-%d') AS ymd FROM dns_events""")
def date_suffix(spark, sf):
    ev = _ev(spark, sf)
    return ev.select("event_id", SK.date_suffix("ts", "daily").alias("daily"), SK.date_suffix("ts", "monthly").alias("monthly"),
                     F.date_format("ts", "HH:mm").alias("hm"), F.date_format("ts", "HH:00").alias("h00"),
                     F.date_format("ts", "MM-dd HH:00").alias("mdh"), F.date_format("ts", "yyyy-MM-dd").alias("ymd"))


@register("json_detail", """
SELECT event_id, domain AS feature, round(score, 4) AS psi FROM dns_events""")
def json_detail(spark, sf):
    ev = _ev(spark, sf)
    d = ev.select("event_id", IN.json_detail(feature=F.col("domain"), psi=F.round("score", 4)).alias("detail"))
    return d.select("event_id", F.get_json_object("detail", "$.feature").alias("feature"),
                    F.get_json_object("detail", "$.psi").cast("double").alias("psi"))


_RANGES = ["now-24h", "now-7d", "now-90m", "now-1d/d", "7d", "2w", "1m", "12h", "bogus"]


@register("relative_range", "\nUNION ALL ".join(
    f"SELECT '{r}' AS range, CAST(count(*) AS BIGINT) AS n FROM dns_events WHERE ts >= {AS_OF} - INTERVAL {iv}"
    for r, iv in [("now-24h", "24 HOURS"), ("now-7d", "7 DAYS"), ("now-90m", "90 MINUTES"), ("now-1d/d", "1 DAYS"),
                  ("7d", "7 DAYS"), ("2w", "14 DAYS"), ("1m", "1 MONTH"), ("12h", "12 HOURS"), ("bogus", "24 HOURS")]))
def relative_range_q(spark, sf):
    ev = _ev(spark, sf)
    parts = [ev.where(F.col("ts") >= relative_range(r, "2024-01-31 00:00:00")).agg(
        F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(r).alias("range"), "n") for r in _RANGES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("event_source", """
SELECT event_id, domain, score FROM dns_events WHERE severity IN ('HIGH', 'CRITICAL') AND event_date >= DATE '2024-01-20'""")
def event_source(spark, sf):
    pred = F.col("severity").isin("HIGH", "CRITICAL") & (F.col("event_date") >= F.lit("2024-01-20").cast("date"))
    return RD.event_source(_ev(spark, sf), pred, ["event_id", "domain", "score"])


@register("read_metadata_table", """
SELECT * FROM operations_v WHERE status = 'pending' AND operation = 'drift_alert' ORDER BY id DESC LIMIT 20""")
def read_metadata_table(spark, sf):
    return RD.read_metadata_table(fx.operations_v(spark, sf), {"status": "pending", "operation": "drift_alert",
                                                               "pipeline_id": None}, "id", 20)


@register("replay", """
SELECT event_id, CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH'
       WHEN score >= CASE tenant_id WHEN 'finance' THEN 0.5 WHEN 'dev' THEN 0.9 ELSE 0.7 END THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       event_date
FROM dns_events WHERE ts >= TIMESTAMP '2024-01-15 10:00:00' AND ts <= TIMESTAMP '2024-01-15 10:59:59.999999'""")
def replay_q(spark, sf):
    from ..operators.rules import apply_threshold
    ev = _ev(spark, sf)
    out = ST.replay_frame(ev, "2024-01-15", lambda d: apply_threshold(d, 0.7, {"finance": 0.5, "dev": 0.9}), hour=10)
    return out.select("event_id", "severity", "event_date")


@register("windowed_counts_tumbling", """
SELECT src_ip, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (WHERE is_dga) AS BIGINT) AS hits
FROM dns_events GROUP BY 1, 2""")
def windowed_counts_tumbling(spark, sf):
    return ST.windowed_counts(_ev(spark, sf), "tumbling", "1 hour")


@register("windowed_counts_sliding", """
WITH w AS (SELECT src_ip, is_dga, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (h) HOUR AS window_start FROM dns_events, range(0, 2) t(h))
SELECT src_ip, window_start, window_start + INTERVAL 2 HOUR AS window_end, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) FILTER (WHERE is_dga) AS BIGINT) AS hits FROM w GROUP BY 1, 2""")
def windowed_counts_sliding(spark, sf):
    return ST.windowed_counts(_ev(spark, sf), "sliding", "2 hours", "1 hour")


@register("windowed_counts_session", """
WITH o AS (SELECT src_ip, ts, is_dga, CASE WHEN lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) IS NULL
             OR ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS brk FROM dns_events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY src_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT src_ip, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end, CAST(count(*) AS BIGINT) AS count,
       CAST(count(*) FILTER (WHERE is_dga) AS BIGINT) AS hits FROM s GROUP BY src_ip, sid""")
def windowed_counts_session(spark, sf):
    return ST.windowed_counts(_ev(spark, sf), "session", gap="30 minutes")


@register("node_error_topn", r"""
SELECT pipeline_id, 'hex_label' AS node, 'ValueError' AS error_type, CAST(count(*) AS BIGINT) AS count
FROM dns_events WHERE NOT regexp_matches(lower(string_split(domain, '.')[1]), '^(0x)?[0-9a-f]+(_[0-9a-f]+)*$')
GROUP BY pipeline_id ORDER BY count DESC, pipeline_id LIMIT 10""")
def node_error_topn(spark, sf):
    from .spec import row_step
    ev = _ev(spark, sf).select("event_id", "domain", "pipeline_id")
    step = row_step(lambda d: str(int(d.split(".")[0], 16)), "domain", "label_value", "hex_label")
    return IN.node_error_topn(step(ev), 10)


_SPEC = """
name: dga-realtime
mode: realtime
version: 2
nodes:
  - {id: parse, type: dns_parser, config: {fields: [query_name, query_type, src_ip, timestamp]}}
  - {id: validate, type: domain_validate, config: {lower: true}}
  - {id: features, type: feature_extractor, config: {extractors: [lexical, entropy]}}
  - {id: mystery, type: not_a_node, config: {}}
  - {id: route, type: score_route, config: {threshold: 0.7, high: alert, low: archive}}
  - {id: sinks, type: fan_out, config: {targets: [{type: es_sink, condition: always}, {type: kafka_sink, condition: is_dga}]}}
"""


@register("pipeline_spec", f"""
SELECT event_id, domain, query_type, CASE WHEN score >= 0.7 THEN 'alert' ELSE 'archive' END AS branch, round({_entropy_sql('domain')}, 6) AS entropy_full
FROM dns_events""")
def pipeline_spec(spark, sf):
    from .spec import pipeline_spec as compile_spec
    p = compile_spec(_SPEC)
    raw = _raw_messages(spark, sf).join(_ev(spark, sf).select("event_id", "score"), "event_id")
    out = p.transform(raw)
    return out.select("event_id", "domain", "query_type", "branch",
                      r6(F.element_at("features", F.lit("entropy_full"))).alias("entropy_full"))


@register("stream_pipeline", """
SELECT event_id, ts, score, CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH' WHEN score >= t THEN 'MEDIUM' ELSE 'LOW' END AS severity, score >= t AS is_dga
FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, floor(value / (value + 10) * 10000 + 0.5) / 10000 AS score,
             CASE user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 ELSE 0.7 END AS t,
             row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n = 1""")
def stream_pipeline(spark, sf):
    """Structured Streaming run over the events file (availableNow): event
    time, 24 h de-duplication, threshold and severity, written per micro-batch
    below the shared checkpoint folder, a new one for each call, then read back."""
    from ..operators.rules import apply_threshold
    from ..session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark)}/stream_pipeline-{uuid.uuid4().hex}"
    out_dir, ck = f"{base}/out", f"{base}/ck"
    schema = fx.table(spark, sf, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))

    def chain(df):
        d = ST.dedupe_stream(df, "event_id", "24 hours")
        d = d.select(F.col("event_id").cast("string").alias("event_id"), "ts",
                     fx.round4(F.col("value") / (F.col("value") + 10)).alias("score"),
                     F.when(F.col("user_id") % 3 == 0, "finance").when(F.col("user_id") % 3 == 1, "dev")
                     .otherwise("default").alias("tenant_id"))
        return apply_threshold(d, 0.7, {"finance": 0.5, "dev": 0.9})

    def sink(batch, epoch):
        rows = batch.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "score", "severity", "is_dga")
        rows.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    q = ST.run_stream(src, chain, sink, ck)
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("epoch")
