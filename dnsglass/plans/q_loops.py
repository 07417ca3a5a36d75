"""Registered queries: feedback loop, drift, operations, correlation, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import AS_OF as CLOCK
from .. import fixtures as fx
from ..operators import correlate as C
from ..operators import drift as DR
from ..operators import feedback as FB
from ..operators import ops as OP
from .catalog import r6, register
from .q_rules import _entropy_sql

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


_FB_COUNTS = f"""fbc AS (SELECT domain, CAST(count(*) FILTER (WHERE true_label = 'benign') AS BIGINT) AS fp_count,
       CAST(count(*) FILTER (WHERE true_label = 'dga') AS BIGINT) AS tp_count
  FROM feedback_v WHERE created_at > {AS_OF} - INTERVAL 30 DAYS AND domain IS NOT NULL GROUP BY domain)"""
_PROMOTE = f"""{_FB_COUNTS},
promo AS (SELECT CASE WHEN fp_count >= 5 AND tp_count = 0 THEN 'whitelist:auto'
                      WHEN tp_count >= 3 AND fp_count = 0 THEN 'blacklist:auto' END AS list_name, domain AS entry
          FROM fbc)"""


@register("feedback_by_domain", f"WITH {_FB_COUNTS} SELECT * FROM fbc")
def feedback_by_domain(spark, sf):
    return FB.feedback_by_domain(fx.feedback_v(spark, sf), CLOCK)


@register("promote_lists", f"WITH {_PROMOTE} SELECT list_name, entry FROM promo WHERE list_name IS NOT NULL")
def promote_lists(spark, sf):
    return FB.promote_lists(fx.feedback_v(spark, sf), CLOCK)


@register("list_diff", f"""WITH {_PROMOTE},
n AS (SELECT DISTINCT list_name, entry FROM promo WHERE list_name IS NOT NULL),
o AS (SELECT DISTINCT list_name, entry FROM list_entries WHERE list_name IN ('whitelist:auto', 'blacklist:auto')),
ch AS (SELECT *, 'promote' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o)
       UNION ALL SELECT *, 'demote' FROM (SELECT * FROM o EXCEPT SELECT * FROM n))
SELECT 'feedback-aggregator' AS user_id,
       'auto_' || CASE WHEN list_name = 'whitelist:auto' THEN 'whitelist' ELSE 'blacklist' END || '_' || change AS action,
       entry AS resource,
       json_object('reason', CASE WHEN change = 'demote' THEN 'signal aged out of window'
                                  WHEN list_name = 'whitelist:auto' THEN '≥5 FP & 0 TP in 30d'
                                  ELSE '≥3 TP & 0 FP in 30d' END)::VARCHAR AS detail
FROM ch""")
def list_diff(spark, sf):
    new = FB.promote_lists(fx.feedback_v(spark, sf), CLOCK)
    old = fx.list_entries(spark, sf).where(F.col("list_name").isin("whitelist:auto", "blacklist:auto"))
    return FB.list_diff(new, old)


@register("except_lists", f"""WITH {_PROMOTE}
SELECT entry FROM promo WHERE list_name = 'blacklist:auto'
EXCEPT SELECT entry FROM list_entries WHERE list_name = 'blacklist:auto'""")
def except_lists(spark, sf):
    new = FB.promote_lists(fx.feedback_v(spark, sf), CLOCK).where(F.col("list_name") == "blacklist:auto").select("entry")
    old = fx.list_entries(spark, sf).where(F.col("list_name") == "blacklist:auto").select("entry")
    return FB.except_lists(new, old)[0]


@register("family_fp_rate", f"""
WITH g AS (SELECT family, count(*) AS n_samples, count(*) FILTER (WHERE true_label = 'benign') AS fp_count,
                  count(*) FILTER (WHERE true_label = 'dga') AS tp_count
           FROM feedback_v WHERE created_at > {AS_OF} - INTERVAL 30 DAYS AND family IS NOT NULL AND family <> ''
           GROUP BY family HAVING count(*) >= 20),
c AS (SELECT json_extract_string(detail, '$.family') AS k FROM operations_v
      WHERE operation = 'threshold_recommendation' AND status = 'pending'
        AND created_at > {AS_OF} - INTERVAL 7 DAYS)
SELECT 'default' AS pipeline_id, 'threshold_recommendation' AS operation, 'feedback-aggregator' AS operator,
       'pending' AS status, family, round(fp_count / n_samples, 3) AS fp_rate, CAST(n_samples AS BIGINT) AS n_samples,
       CAST(fp_count AS BIGINT) AS fp_count, CAST(tp_count AS BIGINT) AS tp_count
FROM g WHERE fp_count / n_samples > 0.2 AND family NOT IN (SELECT k FROM c WHERE k IS NOT NULL)""")
def family_fp_rate(spark, sf):
    out = FB.family_fp_rate(fx.feedback_v(spark, sf), fx.operations_v(spark, sf), CLOCK)
    return out.drop("detail")


_PSI_LONG = """
WITH long AS (SELECT 'score' AS feature, score AS value, 'e' AS side FROM drift_baseline
  UNION ALL SELECT 'domain_len', domain_len, 'e' FROM drift_baseline
  UNION ALL SELECT 'score', score, 'a' FROM drift_current
  UNION ALL SELECT 'domain_len', domain_len, 'a' FROM drift_current),
"""
#: Five features, each further off its baseline; some have a name that the operations table uses.
_SHIFTED = {"g0": 1.0, "f1": 1.5, "g2": 2.0, "f3": 2.5, "g4": 3.0}
_SHIFTED_LONG = "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, score AS value, 'e' AS side FROM drift_baseline UNION ALL SELECT '{n}', score * {x}, 'a' FROM drift_current" for n, x in _SHIFTED.items()) + "),"
_PSI_STEPS = """
ext AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 'e') AS n_e,
               count(*) FILTER (WHERE side = 'a') AS n_a FROM long GROUP BY feature
        HAVING count(*) FILTER (WHERE side = 'a') >= 100 AND count(*) FILTER (WHERE side = 'e') > 0),
cnt AS (SELECT l.feature, CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin,
               count(*) FILTER (WHERE side = 'e') AS c_e, count(*) FILTER (WHERE side = 'a') AS c_a
        FROM long l JOIN ext USING (feature) WHERE hi > lo GROUP BY 1, 2),
grid AS (SELECT ext.*, CAST(b AS INTEGER) AS bin FROM ext, range(10) t(b)),
t AS (SELECT g.feature, g.lo, g.hi, g.n_a, greatest(coalesce(c_e, 0) / n_e, 1e-6) AS e,
             greatest(coalesce(c_a, 0) / n_a, 1e-6) AS a FROM grid g LEFT JOIN cnt c USING (feature, bin)),
psi AS (SELECT feature, sum(CASE WHEN hi = lo THEN 0.0 ELSE (a - e) * ln(a / e) END) AS psi,
               CAST(first(n_a) AS BIGINT) AS window_size FROM t GROUP BY feature)"""


_PSI_SQL = _PSI_LONG + _PSI_STEPS


@register("psi", _PSI_SQL + " SELECT feature, round(psi, 6) AS psi, window_size FROM psi")
def psi(spark, sf):
    b = fx.drift_samples(spark, sf, "baseline")
    c = fx.drift_samples(spark, sf, "current")
    return DR.psi(b, c, ["score", "domain_len"]).select("feature", r6(F.col("psi")).alias("psi"),
                                                        F.col("window_size").cast("long").alias("window_size"))


@register("drift_alerts", _SHIFTED_LONG + _PSI_STEPS + f""",
c AS (SELECT json_extract_string(detail, '$.feature') AS k FROM operations_v
      WHERE operation = 'drift_alert' AND status = 'pending' AND created_at > {AS_OF} - INTERVAL 6 HOURS)
SELECT feature, round(psi, 6) AS psi, 'default' AS pipeline_id, 'drift_alert' AS operation, 'drift-monitor' AS operator, 'pending' AS status, window_size
FROM psi WHERE psi >= 0.25 AND feature NOT IN (SELECT k FROM c WHERE k IS NOT NULL)""")
def drift_alerts(spark, sf):
    """The alerts that the operator raises, less those in cooldown."""
    b = fx.drift_samples(spark, sf, "baseline").select("*", *[F.col("score").alias(n) for n in _SHIFTED])
    c = fx.drift_samples(spark, sf, "current").select("*", *[(F.col("score") * x).alias(n) for n, x in _SHIFTED.items()])
    scores = DR.psi(b, c, list(_SHIFTED))
    out = DR.drift_alerts(scores, fx.operations_v(spark, sf), CLOCK)
    return out.select("feature", r6(F.col("psi")).alias("psi"), "pipeline_id", "operation", "operator", "status",
                      F.get_json_object("detail", "$.window_size").cast("long").alias("window_size"))


@register("psi_ranking", """
SELECT json_extract_string(detail, '$.feature') AS feature, max(CAST(json_extract_string(detail, '$.psi') AS DOUBLE)) AS max_psi
FROM operations_v WHERE operation = 'drift_alert' AND json_extract_string(detail, '$.feature') IS NOT NULL GROUP BY 1""")
def psi_ranking(spark, sf):
    return OP.psi_ranking(fx.operations_v(spark, sf))


@register("operation_stats", """
SELECT 'status' AS dimension, status AS key, CAST(count(*) AS BIGINT) AS count FROM operations_v WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'operation', operation, CAST(count(*) AS BIGINT) FROM operations_v WHERE operation IS NOT NULL GROUP BY operation
UNION ALL SELECT 'pending_by_operation', operation, CAST(count(*) AS BIGINT) FROM operations_v
  WHERE status = 'pending' AND operation IS NOT NULL GROUP BY operation""")
def operation_stats(spark, sf):
    return OP.operation_stats(fx.operations_v(spark, sf))


@register("list_ops_pending", """
SELECT id, pipeline_id, operation, status, json_extract_string(detail, '$.feature') AS feature,
       CAST(json_extract_string(detail, '$.psi') AS DOUBLE) AS psi, CAST(NULL AS VARCHAR) AS raw, created_at
FROM operations_v WHERE status = 'pending' ORDER BY id DESC LIMIT 50""")
def list_ops_pending(spark, sf):
    return OP.list_ops(fx.operations_v(spark, sf), "pending", 50)


@register("list_ops_recent", """
SELECT id, pipeline_id, operation, status, json_extract_string(detail, '$.feature') AS feature,
       CAST(json_extract_string(detail, '$.psi') AS DOUBLE) AS psi, CAST(NULL AS VARCHAR) AS raw, created_at
FROM operations_v ORDER BY id DESC LIMIT 50""")
def list_ops_recent(spark, sf):
    return OP.list_ops(fx.operations_v(spark, sf), "recent", 50)


_REQ_SQL = """req AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'acknowledged' ELSE 'dismissed' END AS new_status
  FROM operations_v WHERE id % 50 = 0 UNION ALL SELECT max(id) + 1, 'dismissed' FROM operations_v)"""


@register("transition_ops", f"""WITH {_REQ_SQL}
SELECT r.id, r.new_status, o.status AS old_status,
       CAST(CASE WHEN o.id IS NULL THEN 404 WHEN o.status <> 'pending' THEN 409 ELSE 200 END AS INTEGER) AS code
FROM req r LEFT JOIN operations_v o ON o.id = r.id""")
def transition_ops(spark, sf):
    ops = fx.operations_v(spark, sf)
    req = (ops.where(F.col("id") % 50 == 0)
           .select("id", F.when(F.col("id") % 2 == 0, "acknowledged").otherwise("dismissed").alias("new_status"))
           .unionByName(ops.agg((F.max("id") + 1).alias("id")).select("id", F.lit("dismissed").alias("new_status"))))
    return OP.transition_ops(ops, req)


@register("transition_snapshot", f"""WITH {_REQ_SQL},
ok AS (SELECT r.id, r.new_status FROM req r JOIN operations_v o ON o.id = r.id WHERE o.status = 'pending')
SELECT o.id, coalesce(ok.new_status, o.status) AS status FROM operations_v o LEFT JOIN ok USING (id)""")
def transition_snapshot(spark, sf):
    ops = fx.operations_v(spark, sf)
    req = (ops.where(F.col("id") % 50 == 0)
           .select("id", F.when(F.col("id") % 2 == 0, "acknowledged").otherwise("dismissed").alias("new_status"))
           .unionByName(ops.agg((F.max("id") + 1).alias("id")).select("id", F.lit("dismissed").alias("new_status"))))
    return OP.apply_transitions(ops, OP.transition_ops(ops, req)).select("id", "status")


@register("agent_metrics", """
WITH r AS (SELECT * FROM agent_runs_v ORDER BY timestamp DESC, run_id LIMIT 200)
SELECT agent AS name, CAST(count(*) AS BIGINT) AS exec_count, round(avg(duration_ms), 1) AS avg_latency,
       round(count(*) FILTER (WHERE status = 'error') / count(*) * 100, 1) AS error_rate
FROM r GROUP BY agent""")
def agent_metrics(spark, sf):
    return OP.agent_metrics(fx.agent_runs_v(spark, sf), 200)


# --- correlation ------------------------------------------------------------------------------

@register("correlate", """
SELECT a.event_id, CAST(count(*) AS BIGINT) AS correlated_count FROM dns_events a JOIN dns_events b
  ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 6 HOURS AND a.ts + INTERVAL 6 HOURS
GROUP BY a.event_id""")
def correlate(spark, sf):
    return C.correlate(_ev(spark, sf), 6 * 3600).select("event_id", F.col("correlated_count").cast("long"))


@register("correlate_5min", """
SELECT a.event_id, CAST(count(*) AS BIGINT) AS correlated_count FROM dns_events a JOIN dns_events b
  ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTES AND a.ts + INTERVAL 5 MINUTES
GROUP BY a.event_id""")
def correlate_5min(spark, sf):
    return C.correlate(_ev(spark, sf), 300).select("event_id", F.col("correlated_count").cast("long"))


@register("correlated_events", """
WITH p AS (SELECT a.event_id AS anchor_id, b.src_ip, b.event_id, b.ts,
                  row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS rank
           FROM dns_events a JOIN dns_events b
             ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 6 HOURS AND a.ts + INTERVAL 6 HOURS
           WHERE a.is_dga AND a.event_id <> b.event_id)
SELECT anchor_id, src_ip, event_id, ts, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3""")
def correlated_events(spark, sf):
    ev = _ev(spark, sf)
    return C.correlated_events(ev, ev.where("is_dga").select("event_id"), 6 * 3600, n=3)


@register("triage", """
WITH c AS (SELECT a.event_id, a.score, count(*) AS n FROM dns_events a JOIN dns_events b
             ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 6 HOURS AND a.ts + INTERVAL 6 HOURS
           GROUP BY a.event_id, a.score)
SELECT event_id, CASE WHEN score >= 0.95 OR n >= 5 THEN 'CRITICAL' WHEN score >= 0.85 OR n >= 3 THEN 'HIGH'
                      WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS triage_severity,
       CASE WHEN score >= 0.95 OR n >= 5 THEN 0.95 WHEN score >= 0.85 OR n >= 3 THEN 0.85
            WHEN score >= 0.7 THEN 0.7 ELSE 0.5 END AS triage_confidence
FROM c""")
def triage(spark, sf):
    return C.triage(_ev(spark, sf), 6 * 3600).select("event_id", "triage_severity", "triage_confidence")


@register("rate_limit", """
SELECT a.request_id, CAST(count(*) AS BIGINT) AS window_count, count(*) <= 2 AS allowed
FROM requests_v a JOIN requests_v b ON a.key = b.key AND b.ts > a.ts - INTERVAL 6 HOURS AND b.ts <= a.ts
GROUP BY a.request_id""")
def rate_limit(spark, sf):
    out = C.rate_limit(fx.requests_v(spark, sf), "key", limit=2, window_sec=6 * 3600)
    return out.select("request_id", F.col("window_count").cast("long"), "allowed")


@register("rate_limit_strict", """
WITH RECURSIVE o AS (SELECT key, request_id, ts, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS n FROM requests_v),
r AS (SELECT key, request_id, ts, n, true AS allowed, [ts] AS acc FROM o WHERE n = 1
  UNION ALL
  SELECT key, request_id, ts, n, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END
  FROM (SELECT o.*, list_filter(r.acc, lambda x: x > o.ts - INTERVAL 6 HOUR) AS live FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) s)
SELECT key, request_id, ts, allowed FROM r""")
def rate_limit_strict(spark, sf):
    return C.rate_limit_strict(fx.requests_v(spark, sf), "key", limit=2, window_sec=6 * 3600)


@register("sliding_domain_features", f"""
WITH h AS (SELECT *, {_entropy_sql('domain')} AS ent FROM dns_events)
SELECT a.event_id, CAST(count(*) AS BIGINT) AS win_queries, CAST(count(DISTINCT b.domain) AS INTEGER) AS win_domains,
       round(avg(b.ent), 6) AS win_mean_entropy, CAST(sum(b.response_size) AS BIGINT) AS win_response_bytes
FROM h a JOIN h b ON a.src_ip = b.src_ip AND b.ts BETWEEN a.ts - INTERVAL 2 HOURS AND a.ts
GROUP BY a.event_id""")
def sliding_domain_features(spark, sf):
    out = C.sliding_domain_features(_ev(spark, sf), 2 * 3600)
    return out.select("event_id", F.col("win_queries").cast("long"), "win_domains",
                      r6(F.col("win_mean_entropy")).alias("win_mean_entropy"),
                      F.col("win_response_bytes").cast("long"))


@register("nxdomain_ratio", """
SELECT src_ip, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_nx) AS BIGINT) AS nx,
       round(count(*) FILTER (WHERE is_nx) / greatest(count(*), 1), 6) AS nx_ratio
FROM dns_events WHERE src_ip IS NOT NULL GROUP BY src_ip""")
def nxdomain_ratio(spark, sf):
    out = C.nxdomain_ratio(_ev(spark, sf))
    return out.select("src_ip", F.col("total").cast("long"), F.col("nx").cast("long"),
                      r6(F.col("nx_ratio")).alias("nx_ratio"))


@register("nxdomain_sessions", """
WITH o AS (SELECT src_ip, ts, is_nx,
             CASE WHEN lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) IS NULL
                    OR ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts) >= INTERVAL 7200 SECONDS THEN 1 ELSE 0 END AS brk
           FROM dns_events WHERE src_ip IS NOT NULL),
s AS (SELECT *, sum(brk) OVER (PARTITION BY src_ip ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT src_ip, min(ts) AS session_start, max(ts) + INTERVAL 7200 SECONDS AS session_end,
       CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE is_nx) AS BIGINT) AS nx,
       round(count(*) FILTER (WHERE is_nx) / greatest(count(*), 1), 6) AS nx_ratio
FROM s GROUP BY src_ip, sid""")
def nxdomain_sessions(spark, sf):
    out = C.nxdomain_sessions(_ev(spark, sf), 3600)
    return out.select("src_ip", "session_start", "session_end", F.col("total").cast("long"),
                      F.col("nx").cast("long"), r6(F.col("nx_ratio")).alias("nx_ratio"))
