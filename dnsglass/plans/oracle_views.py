"""DuckDB text of the fixture mapping (FIXTURES.md §B), used as the CTE preamble
of every oracle statement.  Mirrors `dnsglass.fixtures` column for column."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["dns_base"] = """
SELECT CAST(e.event_id AS VARCHAR) AS event_id,
       't' || CAST(e.event_id AS VARCHAR) AS trace_id,
       e.ts,
       regexp_extract(p.url, '^[a-z]+://([^/:?#]+)', 1) AS domain,
       '10.' || CAST(e.user_id // 65536 AS VARCHAR) || '.' || CAST((e.user_id // 256) % 256 AS VARCHAR)
             || '.' || CAST(e.user_id % 256 AS VARCHAR) AS src_ip,
       167772160 + e.user_id AS ip_long,
       CASE e.k % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'MX' WHEN 3 THEN 'TXT' END AS query_type,
       floor(e.value / (e.value + 10) * 10000 + 0.5) / 10000 AS score,
       e.event_type, e.value, e.user_id, e.k, p.page_id,
       'v1.' || CAST(e.event_id % 2 AS VARCHAR) AS model_version,
       CASE e.k % 4 WHEN 0 THEN 'gateway' WHEN 1 THEN 'dga-realtime-v1' WHEN 2 THEN 'dns-tunnel-v1' END AS pipeline_id,
       CASE WHEN e.k % 4 = 0 THEN e.event_id % 5 = 0 END AS acknowledged,
       CASE e.user_id % 3 WHEN 0 THEN 'finance' WHEN 1 THEN 'dev' ELSE 'default' END AS tenant_id
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
JOIN pages p ON p.page_id = CASE WHEN e.k % 5 = 0 THEN e.k % 10 ELSE e.event_id % (SELECT count(*) FROM pages) END
"""

VIEWS["dns_events"] = """
SELECT event_id, trace_id, ts, domain, src_ip, ip_long, query_type, score,
       score >= 0.7 AS is_dga,
       CASE WHEN score >= 0.7 THEN event_type END AS family,
       CASE WHEN score >= 0.7 THEN floor(score * 0.9 * 10000 + 0.5) / 10000 END AS family_confidence,
       model_version, pipeline_id, tenant_id,
       CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH'
            WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       acknowledged,
       event_type = 'error' AS is_nx,
       CAST(trunc(value) AS INTEGER) AS response_size,
       CAST(ts AS DATE) AS event_date
FROM dns_base
"""

VIEWS["feedback_v"] = """
SELECT event_id, domain,
       CASE WHEN page_id % 3 = 0 THEN 'benign' WHEN page_id % 3 = 1 THEN 'dga'
            WHEN event_type = 'error' THEN 'benign' ELSE 'dga' END AS true_label,
       CASE WHEN score >= 0.7 THEN 'dga' ELSE 'benign' END AS predicted_label,
       score, event_type AS family,
       'analyst-' || CAST(user_id % 3 AS VARCHAR) AS annotator,
       ts AS created_at
FROM dns_base
"""

VIEWS["list_entries"] = """
SELECT CASE WHEN page_id % 7 = 0 THEN 'whitelist:auto' ELSE 'blacklist:auto' END AS list_name,
       regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS entry, 'feedback' AS source
FROM pages WHERE page_id % 7 <= 1
"""

VIEWS["domain_iocs"] = """
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS entry,
       CASE WHEN page_id % 10 = 0 THEN 'feedA' ELSE 'feedB' END AS source,
       'tag' || CAST(page_id % 3 AS VARCHAR) AS tag
FROM pages WHERE page_id % 5 = 0
"""

VIEWS["ip_iocs"] = """
SELECT DISTINCT src_ip AS entry, CASE WHEN user_id % 20 = 0 THEN 'feedA' ELSE 'feedB' END AS source,
       'scanner' AS tag
FROM dns_base WHERE user_id % 10 = 0
"""

VIEWS["geo_ranges"] = """
SELECT CAST(167772160 + 60 * n_nationkey AS BIGINT) AS start_ip,
       CAST(167772160 + 60 * n_nationkey + 59 AS BIGINT) AS end_ip,
       n_name AS country, 'city-' || CAST(n_nationkey AS VARCHAR) AS city, n_regionkey AS asn
FROM nation
"""

VIEWS["intel"] = """
SELECT domain, (page_id % 100) / 100.0 AS reputation,
       'fam' || CAST(page_id % 5 AS VARCHAR) AS malware_family
FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, min(page_id) AS page_id
      FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
"""

VIEWS["operations_v"] = """
SELECT event_id AS id, 'p' || CAST(k % 3 AS VARCHAR) AS pipeline_id,
       CASE WHEN event_type = 'error' THEN 'drift_alert'
            WHEN event_type = 'purchase' THEN 'threshold_recommendation' ELSE 'save' END AS operation,
       'user' || CAST(user_id % 4 AS VARCHAR) AS operator,
       CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'acknowledged' ELSE 'dismissed' END AS status,
       json_object('feature', 'f' || CAST(k % 5 AS VARCHAR), 'psi', round(value / 500, 4)) AS detail,
       ts AS created_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""

VIEWS["pipelines_v"] = """
SELECT * FROM (VALUES ('dga-realtime-v1', 'DGA realtime', 'running', 'realtime'),
                      ('dns-tunnel-v1', 'DNS tunnel', 'stopped', 'realtime'),
                      ('c2-realtime-v1', 'C2 realtime', 'running', 'realtime'))
       AS t(id, name, status, mode)
"""

VIEWS["model_versions_v"] = """
SELECT CAST(p_partkey AS INTEGER) AS id,
       CASE p_partkey % 50 WHEN 0 THEN 'binary' WHEN 1 THEN 'family' ELSE 'm' || CAST(p_partkey % 50 AS VARCHAR) END AS model_id,
       'v1.' || CAST(p_partkey // 50 AS VARCHAR) AS version,
       CASE WHEN p_partkey // 50 < 3 THEN 'production' WHEN p_size % 2 = 0 THEN 'archived' ELSE 'staging' END AS status,
       CAST(p_size % 10 + 1 AS DOUBLE) / 10 AS ab_weight,
       '{"accuracy": 0.' || (p_size + 900) || ', "f1": 0.' || (p_size + 850) || ', "precision": 0.' || (p_size + 860)
         || ', "recall": 0.' || (p_size + 840) || '}' AS metrics,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((p_partkey // 50) % 28 AS INTEGER)) AS created_at,
       CASE WHEN p_size % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((p_partkey // 50) % 28 AS INTEGER)) + INTERVAL 1 DAY END AS deployed_at
FROM part
"""

VIEWS["agent_runs_v"] = f"""
SELECT role AS agent, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS run_id,
       CAST(length(text) AS INTEGER) AS duration_ms,
       CASE WHEN turn % 7 = 6 THEN 'error' ELSE 'success' END AS status,
       {AS_OF} - to_seconds(conv_id * 100 + turn) AS timestamp
FROM conversations
"""

VIEWS["drift_baseline"] = """
SELECT ts, score, CAST(length(domain) AS DOUBLE) AS domain_len FROM dns_events
WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
"""

VIEWS["drift_current"] = """
SELECT ts, score, CAST(length(domain) AS DOUBLE) AS domain_len FROM dns_events
WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
"""

VIEWS["labelled_v"] = """
SELECT lower(replace(p_name, ' ', '-')) || '-' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, p_size % 12)
         || CASE p_partkey % 3 WHEN 0 THEN '.com' WHEN 1 THEN '.net' ELSE '.example.org' END AS domain,
       CAST(p_size % 12 >= 6 AS INTEGER) AS target,
       CASE WHEN p_size % 12 >= 6 THEN p_type ELSE 'alexa' END AS family
FROM part
"""

VIEWS["pred_v"] = """
SELECT l.doc_id, l.quality AS truth, l.toxic AS pred, (d.n_chars % 1000) / 1000.0 AS prob
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""

VIEWS["requests_v"] = """
SELECT user_id AS key, ts, event_id AS request_id FROM events
"""

_ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    """Prefix `sql` with the CTEs it (transitively) references."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
