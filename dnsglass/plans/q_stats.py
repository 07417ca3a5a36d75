"""Registered queries: corpus statistics, windowed metrics and the canned
sample SQL statements run through the read-only SQL entry point."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import stats as S
from .catalog import r6, register
from .sqlapi import ad_hoc_sql, register_event_views


def _lab(spark, sf):
    return fx.labelled_v(spark, sf)


@register("family_counts", "SELECT family, CAST(count(*) AS BIGINT) AS count FROM labelled_v WHERE family <> 'alexa' GROUP BY family")
def family_counts(spark, sf):
    return S.family_counts(_lab(spark, sf))


@register("class_counts", """
SELECT CASE WHEN family = 'alexa' THEN 'benign' ELSE 'dga' END AS class, CAST(count(*) AS BIGINT) AS count
FROM labelled_v GROUP BY 1""")
def class_counts(spark, sf):
    return S.class_counts(_lab(spark, sf))


@register("length_histogram", """
WITH d AS (SELECT CAST(length(trim(domain)) AS DOUBLE) AS len FROM labelled_v WHERE family <> 'alexa'),
e AS (SELECT CASE WHEN min(len) = max(len) THEN min(len) - 0.5 ELSE min(len) END AS lo,
             CASE WHEN min(len) = max(len) THEN max(len) + 0.5 ELSE max(len) END AS hi FROM d),
c AS (SELECT CAST(least(floor((len - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM d, e GROUP BY 1),
g AS (SELECT CAST(b AS INTEGER) AS bin, lo, hi FROM e, range(30) t(b))
SELECT g.bin, round(lo + g.bin * (hi - lo) / 30, 6) AS edge_lo, round(lo + (g.bin + 1) * (hi - lo) / 30, 6) AS edge_hi,
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM g LEFT JOIN c USING (bin)""")
def length_histogram(spark, sf):
    out = S.length_histogram(_lab(spark, sf), 30)
    return out.select("bin", r6(F.col("edge_lo")).alias("edge_lo"), r6(F.col("edge_hi")).alias("edge_hi"), "count")


@register("length_quantiles", """
WITH d AS (SELECT family, length(trim(domain)) AS len FROM labelled_v WHERE family <> 'alexa'),
t AS (SELECT family FROM d GROUP BY family ORDER BY count(*) DESC, family LIMIT 20)
SELECT family, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(len, 0.0), 6) AS min,
       round(quantile_cont(len, 0.25), 6) AS q1, round(quantile_cont(len, 0.5), 6) AS median,
       round(quantile_cont(len, 0.75), 6) AS q3, round(quantile_cont(len, 1.0), 6) AS max
FROM d WHERE family IN (SELECT family FROM t) GROUP BY family""")
def length_quantiles(spark, sf):
    out = S.length_quantiles(_lab(spark, sf), 20)
    return out.select("family", "n", *[r6(F.col(c)).alias(c) for c in ("min", "q1", "median", "q3", "max")])


def _char_sql(where: str) -> str:
    return f"""
WITH c AS (SELECT unnest(string_split(lower(domain), '')) AS char FROM labelled_v WHERE domain IS NOT NULL AND {where}),
g AS (SELECT char, count(*) AS count FROM c WHERE regexp_matches(char, '^[a-z]$') GROUP BY char)
SELECT char, CAST(count AS BIGINT) AS count, round(count / sum(count) OVER (), 6) AS freq FROM g"""


@register("char_distribution_dga", _char_sql("family <> 'alexa'"))
def char_distribution_dga(spark, sf):
    return S.char_distribution(_lab(spark, sf), "dga").withColumn("freq", r6(F.col("freq")))


@register("char_distribution_benign", _char_sql("family = 'alexa'"))
def char_distribution_benign(spark, sf):
    return S.char_distribution(_lab(spark, sf), "benign").withColumn("freq", r6(F.col("freq")))


@register("char_distribution_family", _char_sql("family = 'ECONOMY'"))
def char_distribution_family(spark, sf):
    return S.char_distribution(_lab(spark, sf), "family", "ECONOMY").withColumn("freq", r6(F.col("freq")))


@register("latency_quantile", """
SELECT date_trunc('day', ts) AS window_start, event_type AS label, round(quantile_cont(value, 0.95), 6) AS p
FROM events GROUP BY 1, 2""")
def latency_quantile(spark, sf):
    ev = fx.table(spark, sf, "events")
    out = S.latency_quantile(ev, "value", "event_type", "1 day", 0.95, exact=True)
    return out.withColumn("p", r6(F.col("p")))


@register("windowed_rate", """
SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type AS label, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / 21600.0, 6) AS rate, round(count(*) FILTER (WHERE is_nx) / count(*), 6) AS error_ratio,
       round(count(*) FILTER (WHERE is_dga) / count(*), 6) AS hit_ratio
FROM (SELECT d.*, e.event_type FROM dns_events d JOIN (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events) e
      USING (event_id)) GROUP BY 1, 2""")
def windowed_rate(spark, sf):
    ev = fx.dns_events(spark, sf).join(
        fx.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type"),
        "event_id")
    out = S.windowed_rate(ev, "6 hours", by="event_type", window_seconds=21600)
    return out.select("window_start", "label", "n", *[r6(F.col(c)).alias(c) for c in ("rate", "error_ratio", "hit_ratio")])


@register("sustained_breach", """
WITH m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, tenant_id AS label,
                  count(*) FILTER (WHERE is_dga) / count(*) AS hit_ratio FROM dns_events GROUP BY 1, 2),
b AS (SELECT *, CAST(epoch(window_start) // 3600 AS BIGINT) AS i FROM m WHERE hit_ratio > 0.8),
r AS (SELECT *, i - row_number() OVER (PARTITION BY label ORDER BY i) AS run FROM b)
SELECT label, min(window_start) AS start, max(window_start) AS last, CAST(count(*) AS BIGINT) AS buckets,
       round(max(hit_ratio), 6) AS peak
FROM r GROUP BY label, run HAVING count(*) >= 2""")
def sustained_breach(spark, sf):
    ev = fx.dns_events(spark, sf)
    m = ev.groupBy(F.window("ts", "1 hour").alias("w"), F.col("tenant_id").alias("label")).agg(
        (F.count_if(F.col("is_dga") == F.lit(True)) / F.count(F.lit(1))).alias("hit_ratio"))
    m = m.select(F.col("w.start").alias("window_start"), "label", "hit_ratio")
    out = S.sustained_breach(m, "hit_ratio", ">", 0.8, 2)
    return out.withColumn("peak", r6(F.col("peak")))


# --- AGG-32: canned statements through the read-only SQL entry point ------------------------

# The seven sample statements (dialect adapted: CURDATE() -> as_of date)
SAMPLE_SQL = {
    "high_severity_today": "SELECT COUNT(*) AS cnt FROM dga_events WHERE event_time >= DATE '2024-01-30' "
                           "AND severity IN ('CRITICAL','HIGH')",
    "dga_today": "SELECT COUNT(*) AS cnt FROM dga_events WHERE event_time >= DATE '2024-01-30' AND is_dga = TRUE",
    "daily_dga_7d": "SELECT CAST(event_time AS DATE) AS day, COUNT(*) AS dga_cnt FROM dga_events WHERE is_dga = TRUE "
                    "AND event_time >= DATE '2024-01-24' GROUP BY CAST(event_time AS DATE) ORDER BY day",
    "family_top10": "SELECT family, COUNT(*) AS cnt FROM dga_events WHERE is_dga = TRUE AND family IS NOT NULL "
                    "AND family <> '' GROUP BY family ORDER BY cnt DESC, family LIMIT 10",
    "severity_distribution": "SELECT severity, COUNT(*) AS cnt FROM dga_events GROUP BY severity ORDER BY cnt DESC",
    "hourly_24h": "SELECT date_trunc('hour', event_time) AS hour, COUNT(*) AS cnt FROM dga_events "
                  "WHERE event_time >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY date_trunc('hour', event_time) ORDER BY hour",
    "max_score_top20": "SELECT domain, MAX(score) AS max_score, COUNT(*) AS hits FROM dga_events WHERE is_dga = TRUE "
                       "GROUP BY domain ORDER BY max_score DESC, domain LIMIT 20",
}

_DGA_EVENTS_VIEW = "(SELECT *, ts AS event_time FROM dns_events) AS dga_events"


def _sample(name: str, stmt: str):
    def q(spark, sf):
        register_event_views(spark, sf)
        return ad_hoc_sql(spark, stmt, allowed=["dga_events"])
    return q


for _n, _s in SAMPLE_SQL.items():
    register(f"sample_{_n}", _s.replace("FROM dga_events", f"FROM {_DGA_EVENTS_VIEW}"))(_sample(_n, _s))
