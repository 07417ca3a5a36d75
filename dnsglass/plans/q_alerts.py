"""Registered queries: alert search, grouping, stats, paging, acknowledgement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import AS_OF as CLOCK
from .. import fixtures as fx
from ..operators import alerts as A
from .catalog import register

SEV_RANK_SQL = ("CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 "
                "WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END")


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


# --- AGG-1 (flagship) --------------------------------------------------------------

def alerts_by_domain_df(spark, sf):
    out = A.alerts_by_domain(_ev(spark, sf), size=200)
    return out.withColumn("unique_src_ips", F.array_join("unique_src_ips", ","))


register("alerts_by_domain", f"""
WITH base AS (SELECT domain, src_ip, family, {SEV_RANK_SQL} AS sev_rank, score, ts, acknowledged
              FROM dns_events WHERE domain IS NOT NULL),
dom AS (SELECT domain, count(*) AS alert_count, max(sev_rank) AS sev_rank, max(score) AS max_score,
               min(ts) AS first_seen, max(ts) AS last_seen,
               count(*) FILTER (WHERE acknowledged = false) AS unack
        FROM base GROUP BY domain ORDER BY alert_count DESC, domain LIMIT 200),
ips AS (SELECT domain, src_ip, count(*) AS n FROM base WHERE src_ip IS NOT NULL GROUP BY 1, 2),
ipr AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, src_ip) AS rk FROM ips),
ipl AS (SELECT domain, string_agg(src_ip, ',' ORDER BY rk) FILTER (WHERE rk <= 10) AS unique_src_ips,
               count(*) AS unique_src_ip_count FROM ipr GROUP BY domain),
fam AS (SELECT domain, family, count(*) AS n FROM base WHERE family IS NOT NULL GROUP BY 1, 2),
famtop AS (SELECT domain, arg_min(family, (-n, family)) AS family FROM fam GROUP BY domain)
SELECT d.domain, CAST(d.alert_count AS BIGINT) AS alert_count,
       coalesce(i.unique_src_ips, '') AS unique_src_ips,
       CAST(coalesce(i.unique_src_ip_count, 0) AS BIGINT) AS unique_src_ip_count,
       coalesce(CASE d.sev_rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
                WHEN 1 THEN 'LOW' END, 'LOW') AS max_severity,
       d.max_score, f.family, d.first_seen, d.last_seen, d.unack = 0 AS all_acknowledged
FROM dom d LEFT JOIN ipl i USING (domain) LEFT JOIN famtop f USING (domain)
""")(alerts_by_domain_df)


@register("unique_domain_count", "SELECT CAST(count(DISTINCT domain) AS BIGINT) AS total_unique_domains FROM dns_events")
def unique_domain_count(spark, sf):
    return A.unique_domain_count(_ev(spark, sf))


# --- FLT-5: one query per predicate + combined -------------------------------------------

_LISTING_COLS = "event_id, domain, score, family, severity, ts, src_ip, is_dga, acknowledged, pipeline_id"
_FILTERS = {
    "severity": ({"severity": "HIGH"}, "severity = 'HIGH'"),
    "family": ({"family": "purchase"}, "family = 'purchase'"),
    "acknowledged_true": ({"acknowledged": True}, "acknowledged = true"),
    "acknowledged_false": ({"acknowledged": False}, "acknowledged = false"),
    "domain": ({"domain": "blog"}, "contains(domain, 'blog')"),
    "src_ip": ({"src_ip": "10.0.0.7"}, "src_ip = '10.0.0.7'"),
    "source_manual": ({"source": "manual"}, "(pipeline_id IS NULL OR pipeline_id = 'gateway')"),
    "source_dag": ({"source": "dag"}, "(pipeline_id IS NOT NULL AND pipeline_id <> 'gateway')"),
    "pipeline_id": ({"pipeline_id": "dns-tunnel-v1"}, "pipeline_id = 'dns-tunnel-v1'"),
    "score_range": ({"score_min": 0.5, "score_max": 0.9}, "score >= 0.5 AND score <= 0.9"),
    "time_range": ({"start": "2024-01-10 00:00:00", "end": "2024-01-12 12:00:00"},
                   "ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'"),
    "combined": ({"severity": "MEDIUM", "source": "dag", "domain": "example.net",
                  "score_min": 0.72, "start": "2024-01-05 00:00:00"},
                 "severity = 'MEDIUM' AND pipeline_id IS NOT NULL AND pipeline_id <> 'gateway' "
                 "AND contains(domain, 'example.net') AND score >= 0.72 "
                 "AND ts >= TIMESTAMP '2024-01-05 00:00:00'"),
    "none": ({}, "true"),
}


def _make_filter_query(kw):
    def q(spark, sf):
        return A.alert_filter(_ev(spark, sf), **kw).select(*[c.strip() for c in _LISTING_COLS.split(",")])
    return q


for _name, (_kw, _sql) in _FILTERS.items():
    register(f"alert_filter_{_name}",
             f"SELECT {_LISTING_COLS} FROM dns_events WHERE {_sql}")(_make_filter_query(_kw))


@register("alert_filter_domain_wildcard",
          f"SELECT {_LISTING_COLS} FROM dns_events WHERE domain LIKE '%th%th%.example.%'")
def alert_filter_domain_wildcard(spark, sf):
    return A.alert_filter(_ev(spark, sf), domain="th*th*.example.", domain_wildcards=True).select(
        *[c.strip() for c in _LISTING_COLS.split(",")])


# --- FLT-11 -----------------------------------------------------------------------------

@register("alert_listing", """
SELECT coalesce(event_id, '') AS event_id, coalesce(domain, '') AS domain, coalesce(score, 0.0) AS score,
       coalesce(family, '') AS family, coalesce(severity, 'MEDIUM') AS severity, ts AS timestamp,
       coalesce(src_ip, '') AS src_ip, coalesce(is_dga, true) AS is_dga,
       coalesce(acknowledged, false) AS acknowledged, coalesce(pipeline_id, '') AS pipeline_id
FROM dns_events""")
def alert_listing(spark, sf):
    return A.alert_listing(_ev(spark, sf))


# --- AGG-3 --------------------------------------------------------------------------------

@register("alert_stats", """
SELECT 'total' AS metric, CAST(count(event_id) AS BIGINT) AS value FROM dns_events
UNION ALL SELECT 'pending', CAST(count(*) FILTER (WHERE acknowledged = false) AS BIGINT) FROM dns_events
UNION ALL SELECT 'acknowledged', CAST(count(*) FILTER (WHERE acknowledged = true) AS BIGINT) FROM dns_events
UNION ALL SELECT 'total_yesterday', CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'
                 AND ts < TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) FROM dns_events
UNION ALL SELECT * FROM (SELECT 'severity:' || severity, CAST(count(*) AS BIGINT) AS c FROM dns_events
                 WHERE severity IS NOT NULL GROUP BY severity ORDER BY c DESC, severity LIMIT 10)""")
def alert_stats(spark, sf):
    return A.alert_stats(_ev(spark, sf), CLOCK)


# --- SRT-1, FLT-13, FLT-14, SRT-2, SRT-3 -----------------------------------------------------

@register("page", """
SELECT e.event_id, e.domain, e.score, e.ts, t.total FROM
 (SELECT event_id, domain, score, ts FROM dns_events ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50) e,
 (SELECT CAST(count(*) AS BIGINT) AS total FROM dns_events) t""")
def page_q(spark, sf):
    return A.page(_ev(spark, sf).select("event_id", "domain", "score", "ts"), offset=50, limit=25)


@register("get_event", "SELECT event_id, domain, score, severity, ts FROM dns_events WHERE event_id = '1234'")
def get_event(spark, sf):
    return A.get_event(_ev(spark, sf), "1234").select("event_id", "domain", "score", "severity", "ts")


@register("related_alerts", """
WITH anchor AS (SELECT event_id AS anchor_id, src_ip AS a_ip FROM dns_events
                WHERE is_dga AND coalesce(src_ip, '') <> ''),
pairs AS (SELECT c.event_id, c.domain, c.score, c.severity, c.ts, c.src_ip, a.anchor_id,
                 row_number() OVER (PARTITION BY a.anchor_id ORDER BY c.ts DESC, c.event_id) AS rank
          FROM dns_events c JOIN anchor a ON c.src_ip = a.a_ip WHERE c.event_id <> a.anchor_id)
SELECT event_id, domain, score, severity, ts, src_ip, anchor_id, CAST(rank AS INTEGER) AS rank
FROM pairs WHERE rank <= 5""")
def related_alerts(spark, sf):
    ev = _ev(spark, sf)
    return A.related_alerts(ev, ev.where("is_dga").select("event_id"), n=5)


@register("high_score_feed", """
SELECT event_id, domain, score, ts FROM dns_events WHERE score >= 0.7
ORDER BY ts DESC, event_id DESC LIMIT 50""")
def high_score_feed(spark, sf):
    return A.high_score_feed(_ev(spark, sf).select("event_id", "domain", "score", "ts"), 0.7, 50)


@register("recent_dga", """
SELECT coalesce(event_id, '') AS event_id, coalesce(domain, '') AS domain, coalesce(score, 0.0) AS score,
       coalesce(family, 'unknown') AS family, coalesce(severity, 'medium') AS severity, ts AS timestamp
FROM dns_events WHERE is_dga = true ORDER BY ts DESC, event_id LIMIT 30""")
def recent_dga(spark, sf):
    return A.recent_dga(_ev(spark, sf), 30)


@register("threat_report", """
SELECT event_id, domain, score, family, severity, src_ip, ts FROM dns_events
WHERE is_dga = true AND score >= 0.7 AND ts >= TIMESTAMP '2024-01-24 00:00:00'
ORDER BY score DESC, ts DESC, event_id LIMIT 100""")
def threat_report(spark, sf):
    return A.threat_report(_ev(spark, sf), start="2024-01-24 00:00:00", n=100)


# --- UPD-1 ----------------------------------------------------------------------------------

@register("acknowledge_by_domain", """
WITH req AS (SELECT DISTINCT domain FROM dns_events WHERE domain LIKE 'blog.%'),
snap AS (SELECT e.event_id, e.domain,
                coalesce(r.domain IS NOT NULL AND e.acknowledged = false, false) AS updated, e.acknowledged
         FROM dns_events e LEFT JOIN req r ON e.domain = r.domain)
SELECT event_id, domain, updated, CASE WHEN updated THEN true ELSE acknowledged END AS acknowledged FROM snap""")
def acknowledge_by_domain(spark, sf):
    ev = _ev(spark, sf)
    req = ev.where(F.col("domain").startswith("blog.")).select("domain").distinct()
    return A.acknowledge(ev, domains=req).select("event_id", "domain", "updated", "acknowledged")
