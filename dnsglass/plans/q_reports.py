"""Registered queries: dashboard, reports, windows and top-k operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..schema import AS_OF as CLOCK
from .. import fixtures as fx
from ..operators import reports as R
from ..operators.common import top_k, top_k_per_group
from .catalog import r6, register

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


_DASH_CHOICE = f"""
s AS (SELECT count(*) FILTER (WHERE event_date = DATE '2024-01-31') AS n_today,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOURS) AS n_h24,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 30 DAYS) AS n_d30,
             count(*) FILTER (WHERE event_date = DATE '2024-01-31' AND is_dga) AS h_today,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOURS AND is_dga) AS h_h24,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 30 DAYS AND is_dga) AS h_d30 FROM dns_events),
c AS (SELECT CASE WHEN n_today > 0 THEN 'today' WHEN n_h24 > 0 THEN '24h' ELSE '30d' END AS "window",
             CASE WHEN n_today > 0 THEN n_today WHEN n_h24 > 0 THEN n_h24 ELSE n_d30 END AS total,
             CASE WHEN n_today > 0 THEN h_today WHEN n_h24 > 0 THEN h_h24 ELSE h_d30 END AS dga_hits FROM s)"""


@register("dashboard_counts", f"""WITH {_DASH_CHOICE}
SELECT "window", CAST(total AS BIGINT) AS total, CAST(dga_hits AS BIGINT) AS dga_hits,
       round(dga_hits / greatest(total, 1) * 100, 2) AS hit_rate,
       CASE WHEN total > 0 THEN round(greatest(8.0, least(200.0, 5000.0 / greatest(total, 1))), 1) ELSE 0.0 END
         AS p95_latency
FROM c""")
def dashboard_counts(spark, sf):
    return R.dashboard_counts(_ev(spark, sf), CLOCK)


@register("dashboard_families", f"""WITH {_DASH_CHOICE},
f AS (SELECT family, count(*) FILTER (WHERE event_date = DATE '2024-01-31') AS f_today,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 24 HOURS) AS f_h24,
             count(*) FILTER (WHERE ts >= {AS_OF} - INTERVAL 30 DAYS) AS f_d30
      FROM dns_events WHERE family IS NOT NULL GROUP BY family),
v AS (SELECT family, CASE c."window" WHEN 'today' THEN f_today WHEN '24h' THEN f_h24 ELSE f_d30 END AS value
      FROM f, c)
SELECT family AS name, CAST(value AS BIGINT) AS value FROM v WHERE value > 0
ORDER BY value DESC, family LIMIT 10""")
def dashboard_families(spark, sf):
    return R.dashboard_families(_ev(spark, sf), CLOCK)


@register("family_distribution", """
SELECT family AS name, CAST(count(*) AS BIGINT) AS value FROM dns_events WHERE family IS NOT NULL
GROUP BY family ORDER BY value DESC, family LIMIT 10""")
def family_distribution(spark, sf):
    return R.family_distribution(_ev(spark, sf), 10)


@register("qps_history", f"""
WITH b AS (
  SELECT 1 AS level, date_trunc('minute', ts) AS bucket, is_dga FROM dns_events WHERE ts >= {AS_OF} - INTERVAL 60 MINUTES
  UNION ALL SELECT 2, date_trunc('hour', ts), is_dga FROM dns_events WHERE ts >= {AS_OF} - INTERVAL 24 HOURS
  UNION ALL SELECT 3, date_trunc('hour', ts), is_dga FROM dns_events WHERE ts >= {AS_OF} - INTERVAL 7 DAYS
  UNION ALL SELECT 4, date_trunc('day', ts), is_dga FROM dns_events WHERE ts >= {AS_OF} - INTERVAL 30 DAYS),
g AS (SELECT level, bucket, count(*) AS qps, count(*) FILTER (WHERE is_dga) AS hits FROM b GROUP BY 1, 2),
ch AS (SELECT * FROM g WHERE level = (SELECT min(level) FROM g)),
r AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS rn FROM ch)
SELECT CAST(level AS INTEGER) AS level, bucket,
       CASE level WHEN 1 THEN strftime(bucket, '%H:%M') WHEN 2 THEN strftime(bucket, '%H:00')
                  WHEN 3 THEN strftime(bucket, '%m-%d %H:00') ELSE strftime(bucket, '%Y-%m-%d') END AS time,
       CAST(qps AS BIGINT) AS qps, CAST(hits AS BIGINT) AS hits
FROM r WHERE rn <= CASE level WHEN 1 THEN 60 WHEN 2 THEN 24 WHEN 3 THEN 168 ELSE 30 END""")
def qps_history(spark, sf):
    return R.qps_history(_ev(spark, sf), CLOCK)


@register("daily_trend", f"""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE is_dga) AS dga
           FROM dns_events WHERE ts >= {AS_OF} - INTERVAL 7 DAYS GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT s.day, strftime(s.day, '%-m/%-d') AS date, CAST(coalesce(total, 0) AS BIGINT) AS total,
       CAST(coalesce(dga, 0) AS BIGINT) AS dga
FROM s LEFT JOIN d USING (day)""")
def daily_trend(spark, sf):
    return R.daily_trend(_ev(spark, sf), days=7, as_of=CLOCK)


@register("daily_trend_range", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE is_dga) AS dga
           FROM dns_events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
           AND domain = 'ththre.example.com' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT s.day, strftime(s.day, '%-m/%-d') AS date, CAST(coalesce(total, 0) AS BIGINT) AS total,
       CAST(coalesce(dga, 0) AS BIGINT) AS dga
FROM s LEFT JOIN d USING (day)""")
def daily_trend_range(spark, sf):
    ev = _ev(spark, sf).where(F.col("domain") == "ththre.example.com")
    return R.daily_trend(ev, start="2024-01-03 00:00:00", end="2024-01-20 00:00:00")


@register("top_domains", """
WITH g AS (SELECT domain, count(*) AS count FROM dns_events WHERE is_dga AND domain IS NOT NULL
           GROUP BY domain ORDER BY count DESC, domain LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY count DESC, domain) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY count DESC, domain) - 1 AS INTEGER) AS key,
       domain, CAST(count AS BIGINT) AS count, '' AS family FROM g""")
def top_domains(spark, sf):
    return R.top_domains(_ev(spark, sf), 10)


@register("top_hosts", """
WITH g AS (SELECT src_ip, count(*) AS alerts, count(DISTINCT domain) AS unique_domains FROM dns_events
           WHERE is_dga AND src_ip IS NOT NULL GROUP BY src_ip ORDER BY alerts DESC, src_ip LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY alerts DESC, src_ip) AS INTEGER) AS rank,
       CAST(row_number() OVER (ORDER BY alerts DESC, src_ip) - 1 AS INTEGER) AS key,
       src_ip, CAST(alerts AS BIGINT) AS alerts, CAST(unique_domains AS BIGINT) AS unique_domains FROM g""")
def top_hosts(spark, sf):
    return R.top_hosts(_ev(spark, sf), 10)


@register("heatmap", """
WITH c AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, count(*) AS n
           FROM dns_events GROUP BY 1, 2),
g AS (SELECT CAST(h AS INTEGER) AS hour, CAST(d AS INTEGER) AS weekday FROM range(24) t(h), range(7) u(d))
SELECT g.hour, g.weekday, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (hour, weekday)""")
def heatmap(spark, sf):
    return R.heatmap(_ev(spark, sf))


@register("pipeline_stats", """
WITH dga AS (SELECT * FROM dns_events WHERE is_dga),
byp AS (SELECT pipeline_id, count(*) AS n FROM dga WHERE pipeline_id IS NOT NULL GROUP BY 1
        ORDER BY n DESC, pipeline_id LIMIT 10),
tot AS (SELECT count(*) AS total FROM pipelines_v)
SELECT 'status' AS section, status AS name, CAST(count(*) AS DOUBLE) AS value FROM pipelines_v GROUP BY status
UNION ALL SELECT 'pipeline', b.pipeline_id || '|' || coalesce(p.name, substr(b.pipeline_id, 1, 8)), CAST(b.n AS DOUBLE)
  FROM byp b LEFT JOIN pipelines_v p ON p.id = b.pipeline_id
UNION ALL SELECT * FROM (SELECT 'family', family, CAST(count(*) AS DOUBLE) AS v FROM dga WHERE family IS NOT NULL
  GROUP BY family ORDER BY v DESC, family LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'severity', severity, CAST(count(*) AS DOUBLE) AS v FROM dga
  WHERE severity IS NOT NULL GROUP BY severity ORDER BY v DESC, severity LIMIT 5)
UNION ALL SELECT 'summary', 'alert_rate', round((SELECT count(*) FROM byp) / greatest(total, 1) * 100, 1) FROM tot
UNION ALL SELECT 'summary', 'total', CAST(total AS DOUBLE) FROM tot""")
def pipeline_stats(spark, sf):
    return R.pipeline_stats(_ev(spark, sf), fx.pipelines_v(spark))


@register("alert_summary", f"""
WITH d AS (SELECT * FROM dns_events WHERE is_dga AND ts >= {AS_OF} - INTERVAL 7 DAYS AND severity IS NOT NULL),
sev AS (SELECT severity, count(*) AS ns FROM d GROUP BY 1 ORDER BY ns DESC, severity LIMIT 20),
sf AS (SELECT severity, family, count(*) AS count FROM d WHERE family IS NOT NULL
       AND severity IN (SELECT severity FROM sev) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY count DESC, family) AS rn FROM sf)
SELECT severity, family, CAST(count AS BIGINT) AS count FROM r WHERE rn <= 50""")
def alert_summary(spark, sf):
    return R.alert_summary(_ev(spark, sf), start="2024-01-24 00:00:00")


@register("top_domains_daily", """
SELECT CAST(ts AS DATE) AS stat_date, domain, CAST(count(*) AS BIGINT) AS hit_count,
       round(sum(score), 4) AS sum_score, max(score) AS max_score,
       coalesce(array_to_string(list_sort(list_distinct(list(family))), ','), '') AS families,
       CAST(count(DISTINCT src_ip) AS BIGINT) AS src_ip_count
FROM dns_events WHERE domain IS NOT NULL GROUP BY 1, 2""")
def top_domains_daily(spark, sf):
    # avg_score * hit_count recovers the 4-dp sum exactly (avoids 6-dp ties of the mean)
    out = R.top_domains_daily(_ev(spark, sf))
    return out.withColumn("avg_score", F.round(F.col("avg_score") * F.col("hit_count"), 4)) \
        .withColumnRenamed("avg_score", "sum_score")


@register("p95_estimate", """
SELECT CAST(count(*) AS BIGINT) AS total,
       CASE WHEN count(*) > 0 THEN round(greatest(8.0, least(200.0, 5000.0 / greatest(count(*), 1))), 1) ELSE 0.0 END
         AS p95_latency
FROM dns_events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00'""")
def p95_estimate_q(spark, sf):
    ev = _ev(spark, sf).where(F.col("ts") >= F.lit("2024-01-30 18:00:00").cast("timestamp_ntz"))
    t = ev.agg(F.count(F.lit(1)).cast("long").alias("total"))
    return t.select("total", R.p95_estimate(F.col("total")).alias("p95_latency"))


# --- WIN-2 / WIN-5 / WIN-6 / WIN-7 --------------------------------------------------------

@register("last_n", """
SELECT event_id, domain, score, ts FROM dns_events ORDER BY ts DESC, event_id LIMIT 1000""")
def last_n(spark, sf):
    from ..operators.ops import last_n as op
    return op(_ev(spark, sf).select("event_id", "domain", "score", "ts"), 1000)


@register("last_n_by_tenant", """
SELECT event_id, tenant_id, ts, CAST(rank AS INTEGER) AS rank FROM (
  SELECT event_id, tenant_id, ts, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, event_id) AS rank
  FROM dns_events) WHERE rank <= 100""")
def last_n_by_tenant(spark, sf):
    from ..operators.ops import last_n as op
    return op(_ev(spark, sf).select("event_id", "tenant_id", "ts"), 100, by=["tenant_id"])


@register("top_k_per_group", """
WITH g AS (SELECT domain, family, count(*) AS n, min(family_confidence) AS min_conf FROM dns_events
           WHERE is_dga AND family IS NOT NULL AND family_confidence >= 0.3 GROUP BY 1, 2)
SELECT domain, family, CAST(n AS BIGINT) AS n, min_conf, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, family) AS rank FROM g) WHERE rank <= 3""")
def top_k_per_group_q(spark, sf):
    ev = _ev(spark, sf).where((F.col("is_dga") == F.lit(True)) & F.col("family").isNotNull()
                              & (F.col("family_confidence") >= 0.3))
    g = ev.groupBy("domain", "family").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                           F.min("family_confidence").alias("min_conf"))
    return top_k_per_group(g, ["domain"], [F.desc("n"), F.asc("family")], 3)


@register("latest_per_key", """
SELECT pipeline_id, arg_max(status, (created_at, id)) AS status, max(created_at) AS created_at
FROM operations_v GROUP BY pipeline_id""")
def latest_per_key(spark, sf):
    from ..operators.ops import latest_per_key as op
    return op(fx.operations_v(spark, sf), ["pipeline_id"], "created_at", ["status"], tie="id")


@register("cumulative_weight", """
SELECT model_id, version, id, ab_weight,
       round(sum(ab_weight) OVER (PARTITION BY model_id ORDER BY id ROWS UNBOUNDED PRECEDING)
             / sum(ab_weight) OVER (PARTITION BY model_id), 6) AS cum_share
FROM model_versions_v WHERE status = 'production'""")
def cumulative_weight(spark, sf):
    from ..operators.registry import cumulative_weight as op
    return op(fx.model_versions_v(spark, sf).where(F.col("status") == "production")).select(
        "model_id", "version", "id", "ab_weight", r6(F.col("cum_share")).alias("cum_share"))
