"""Registered queries: domain features (SCA / FLT-2..4) and detection rules
(lists, thresholds, routing, IOC, geo, intel, scoring rules)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import domain as D
from ..operators import rules as RU
from ..schema import severity_scale
from .catalog import r6, register


def _ev(spark, sf):
    return fx.dns_events(spark, sf)


# --- DuckDB expression builders for the oracle (text only) ----------------------

def _cnt(s: str, cls: str) -> str:
    return f"length(regexp_replace({s}, '{cls}', '', 'g'))"


def _ratios_sql(s: str, suf: str) -> list[str]:
    n = f"length({s})"

    def ratio(c):
        return f"CASE WHEN {n} = 0 THEN 0.0 ELSE ({c}) / {n} END"
    return [f"CAST({n} AS DOUBLE) AS L{suf}",
            f"round({ratio(_cnt(s, '[^bcdfghjklmnpqrstvwxyz]'))}, 6) AS Rc{suf}",
            f"round({ratio(_cnt(s, '[^aeiou]'))}, 6) AS Rv{suf}",
            f"round({ratio(_cnt(s, '[^\\p{Nd}]'))}, 6) AS Rn{suf}",
            f"round({ratio(_cnt(s, '[^\\p{L}]'))}, 6) AS Rl{suf}",
            f"round({ratio(f'{n} - ' + _cnt(s, '[^\\p{L}\\p{N}]'))}, 6) AS Rs{suf}"]


def _entropy_sql(s: str) -> str:
    chars = f"string_split({s}, '')"
    p = f"(len(list_filter({chars}, lambda x: x = c)) / length({s}))"
    return (f"CASE WHEN length({s}) = 0 THEN 0.0 ELSE "
            f"-list_sum(list_transform(list_distinct({chars}), lambda c: {p} * log2({p}))) END")


def _class_entropy_sql(s: str) -> str:
    n = f"length({s})"
    terms = [_cnt(s, '[^\\p{L}]'), _cnt(s, '[^\\p{Nd}]'), f"({n} - {_cnt(s, '[^\\p{L}\\p{Nd}]')})"]
    parts = " + ".join(f"CASE WHEN {t} > 0 THEN ({t} / {n}) * log2({t} / {n}) ELSE 0 END" for t in terms)
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE -({parts}) END"


_SPLIT = """(SELECT domain, parts, len(parts) AS n,
    CASE WHEN len(parts) >= 2 THEN parts[-1] ELSE '' END AS tld,
    CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE parts[1] END AS sld,
    CASE WHEN len(parts) >= 3 THEN array_to_string(parts[1:len(parts) - 2], '.') ELSE '' END AS sub
  FROM (SELECT domain, string_split(domain, '.') AS parts FROM labelled_v))"""


def _run_sql(pat: str) -> str:
    return f"CAST(coalesce(list_max(list_transform(regexp_extract_all(domain, '{pat}'), lambda r: length(r))), 0) AS DOUBLE)"


_LEX_SQL = ", ".join(
    ["CASE WHEN sub <> '' THEN 3.0 ELSE 2.0 END AS N",
     f"{_run_sql('[^aeiou0-9\\s\\W]+')} AS LCc", f"{_run_sql('[aeiou]+')} AS LCv", f"{_run_sql('[0-9]+')} AS LCn"]
    + _ratios_sql("tld", "_tld") + _ratios_sql("sld", "_sld") + _ratios_sql("sub", "_sub"))


# --- SCA-7 / SCA-5 / SCA-6 / FLT-3 ---------------------------------------------------------

@register("lexical_features", f"SELECT domain, {_LEX_SQL} FROM {_SPLIT}")
def lexical_features(spark, sf):
    d = fx.labelled_v(spark, sf).select("domain")
    out = d.select("domain", D.lexical_features(F.col("domain")).alias("f")).select("domain", "f.*")
    return out.select("domain", *[r6(F.col(c)).alias(c) if c.startswith("R") else F.col(c)
                                  for c in out.columns if c != "domain"])


@register("split_domain", f"SELECT domain, sub AS subdomain, sld, tld FROM {_SPLIT}")
def split_domain(spark, sf):
    d = fx.labelled_v(spark, sf).select("domain")
    return d.select("domain", D.split_domain(F.col("domain")).alias("p")).select("domain", "p.*")


@register("registered_domain", """
SELECT domain, CASE WHEN len(string_split(domain, '.')) >= 2
       THEN array_to_string(string_split(domain, '.')[-2:], '.') ELSE domain END AS registered
FROM (SELECT DISTINCT domain FROM dns_events)""")
def registered_domain(spark, sf):
    d = _ev(spark, sf).select("domain").distinct()
    return d.select("domain", D.registered_domain(F.col("domain")).alias("registered"))


# --- SCA-1..4 --------------------------------------------------------------------------------

@register("entropy_features", f"""
SELECT domain, round({_entropy_sql('domain')}, 6) AS entropy_full, round({_entropy_sql('sld')}, 6) AS entropy_sld,
       round({_class_entropy_sql('sld')}, 6) AS char_class_entropy,
       round(CASE WHEN length(sld) = 0 THEN 0 ELSE len(list_distinct(string_split(sld, ''))) END
             / greatest(length(sld), 1), 6) AS unique_char_ratio
FROM {_SPLIT}""")
def entropy_features(spark, sf):
    d = fx.labelled_v(spark, sf).select("domain")
    out = d.select("domain", D.entropy_features(F.col("domain")).alias("f")).select("domain", "f.*")
    return out.select("domain", *[r6(F.col(c)).alias(c) for c in out.columns if c != "domain"])


@register("shannon_entropy_base", f"""
SELECT domain, round({_entropy_sql('domain')}, 6) AS h2,
       round({_entropy_sql('domain')} * ln(2) / ln(10), 6) AS h10
FROM (SELECT DISTINCT domain FROM dns_events)""")
def shannon_entropy_base(spark, sf):
    d = _ev(spark, sf).select("domain").distinct()
    return d.select("domain", r6(D.shannon_entropy(F.col("domain"))).alias("h2"),
                    r6(D.shannon_entropy(F.col("domain"), 10.0)).alias("h10"))


# --- SCA-8 -----------------------------------------------------------------------------------

@register("extract_features", f"""
WITH f AS (SELECT domain, {_LEX_SQL}, round({_entropy_sql('domain')}, 6) AS entropy_full, round({_entropy_sql('sld')}, 6) AS entropy_sld,
       round({_class_entropy_sql('sld')}, 6) AS char_class_entropy,
       round(CASE WHEN length(sld) = 0 THEN 0 ELSE len(list_distinct(string_split(sld, ''))) END
             / greatest(length(sld), 1), 6) AS unique_char_ratio
  FROM {_SPLIT.replace('labelled_v', '(SELECT DISTINCT domain FROM dns_events)')})
SELECT event_id, f.* FROM dns_events JOIN f USING (domain)""")
def extract_features(spark, sf):
    """All 26 features of every event, read back from the map."""
    from ..operators.ingest import extract_features as op
    out = op(_ev(spark, sf).select("event_id", "domain"), ("lexical", "entropy"))
    names = [k for k, _ in D.lexical_feature_list("domain") + D.entropy_feature_list("domain")]
    return out.select("event_id", "domain", *[r6(F.element_at("features", F.lit(n))).alias(n) for n in names])


# --- FLT-2 -----------------------------------------------------------------------------------

@register("validate_domains", """
SELECT raw, lower(trim(raw)) AS domain FROM (
  SELECT CASE WHEN p_partkey % 7 = 3 THEN '_' ELSE '' END || replace(p_name, ' ', CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '-' END)
         || CASE WHEN p_partkey % 4 = 0 THEN '.COM ' WHEN p_partkey % 4 = 1 THEN '.net'
                 WHEN p_partkey % 4 = 2 THEN '-' ELSE '' END AS raw FROM part)
WHERE length(lower(trim(raw))) > 0 AND length(lower(trim(raw))) <= 253
  AND regexp_matches(lower(trim(raw)), '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$')""")
def validate_domains(spark, sf):
    p = fx.table(spark, sf, "part")
    name = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "-"))
    raw = F.concat(F.when(F.col("p_partkey") % 7 == 3, "_").otherwise(""), name,
                   F.when(F.col("p_partkey") % 4 == 0, ".COM ")
                   .when(F.col("p_partkey") % 4 == 1, ".net").when(F.col("p_partkey") % 4 == 2, "-")
                   .otherwise(""))
    d = p.select(raw.alias("raw")).withColumn("domain", D.normalize_domain(F.col("raw")))
    return d.where(D.is_valid_domain(F.col("domain")))


# --- SCA-9 / SCA-10 / SCA-11 / SCA-14 / SCA-15 --------------------------------------------------

@register("ratio_extractors", """
SELECT domain,
  round(length(regexp_replace(fl, '[^\\p{Nd}]', '', 'g')) / greatest(length(fl), 1), 6) AS digit_ratio,
  round(length(regexp_replace(fl, '[^aeiouAEIOU]', '', 'g')) / greatest(length(fl), 1), 6) AS vowel_ratio,
  round((length(regexp_replace(fl, '[^\\p{L}]', '', 'g')) - length(regexp_replace(fl, '[^aeiouAEIOU]', '', 'g')))
        / greatest(length(fl), 1), 6) AS consonant_ratio
FROM (SELECT domain, split_part(domain, '.', 1) AS fl FROM labelled_v)""")
def ratio_extractors(spark, sf):
    d = fx.labelled_v(spark, sf).select("domain")
    out = d.select("domain", D.ratio_extractors(F.col("domain")).alias("r")).select("domain", "r.*")
    return out.select("domain", *[r6(F.col(c)).alias(c) for c in out.columns if c != "domain"])


@register("risk_band", """
SELECT event_id, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS risk
FROM dns_events""")
def risk_band(spark, sf):
    return _ev(spark, sf).select("event_id", D.risk_band(F.col("score")).alias("risk"))


@register("explain_flags", f"""
SELECT domain,
  (length(regexp_replace(fl, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(fl), 1) > 0.3) OR length(fl) > 15 AS machine_generated,
  {_entropy_sql('domain')} > 3.5 AS high_entropy
FROM (SELECT DISTINCT domain, split_part(domain, '.', 1) AS fl FROM labelled_v)""")
def explain_flags(spark, sf):
    from ..operators.explain import explain_flags as op
    d = fx.labelled_v(spark, sf).select("domain").distinct()
    return op(d).select("domain", "machine_generated", "high_entropy")


@register("explain_rows", """
SELECT event_id, CAST(dim AS INTEGER) AS dim, title FROM dns_events,
  (VALUES (0, 'character'), (1, 'entropy'), (2, 'family'), (3, 'behaviour')) t(dim, title)
WHERE is_dga""")
def explain_rows(spark, sf):
    from ..operators.explain import explain_rows as op
    ev = _ev(spark, sf).where("is_dga")
    return op(ev).select("event_id", "dim", "title")


@register("ab_ratio", """
SELECT trace_id, round(CAST(('0x' || substr(md5(trace_id), 1, 8)) AS BIGINT) / 4294967295.0, 6) AS ratio
FROM dns_events""")
def ab_ratio(spark, sf):
    return _ev(spark, sf).select("trace_id", r6(D.ab_ratio(F.col("trace_id"))).alias("ratio"))


@register("cache_key", """
SELECT DISTINCT domain, 'score:' || substr(sha256(domain), 1, 16) AS cache_key FROM dns_events""")
def cache_key(spark, sf):
    return _ev(spark, sf).select("domain").distinct().select("domain", D.cache_key(F.col("domain")).alias("cache_key"))


# --- FLT-7 .. FLT-10 ---------------------------------------------------------------------------

@register("apply_threshold", """
SELECT event_id, t AS threshold, score >= t AS is_dga,
       CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH' WHEN score >= t THEN 'MEDIUM'
            ELSE 'LOW' END AS severity,
       'threshold:' || CAST(t AS VARCHAR) AS rule
FROM (SELECT *, CASE tenant_id WHEN 'finance' THEN 0.5 WHEN 'dev' THEN 0.9 ELSE 0.7 END AS t FROM dns_events)""")
def apply_threshold(spark, sf):
    out = RU.apply_threshold(_ev(spark, sf), 0.7, {"finance": 0.5, "dev": 0.9})
    return out.select("event_id", "threshold", "is_dga", "severity",
                      F.element_at("rules_applied", -1).alias("rule"))


@register("threshold_action_drop", "SELECT event_id, score FROM dns_events WHERE score >= 0.2 AND score >= 0.8")
def threshold_action_drop(spark, sf):
    return RU.threshold_action(_ev(spark, sf), 0.8, "drop", min_score=0.2).select("event_id", "score")


@register("threshold_action_pass", """
SELECT event_id, CASE WHEN score >= 0.8 THEN 'alert' ELSE 'normal' END AS verdict FROM dns_events""")
def threshold_action_pass(spark, sf):
    return RU.threshold_action(_ev(spark, sf), 0.8, "pass_normal").select("event_id", "verdict")


@register("severity_tag", """
SELECT event_id, CASE WHEN value_score >= 0.9 THEN 'CRITICAL' WHEN value_score >= 0.8 THEN 'HIGH'
                      WHEN value_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT event_id, score AS value_score FROM dns_events)""")
def severity_tag(spark, sf):
    d = _ev(spark, sf).select("event_id", F.col("score").alias("value_score"))
    return RU.severity_tag(d, 0.9, 0.8, 0.6, "value_score", "level").select("event_id", "level")


@register("severity_scales", """
SELECT event_id,
  CASE WHEN score >= 0.95 THEN 'CRITICAL' WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS sev_a,
  CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS sev_b
FROM dns_events""")
def severity_scales(spark, sf):
    return _ev(spark, sf).select("event_id", severity_scale("A", "score", 0.7).alias("sev_a"),
                                 severity_scale("B", "score").alias("sev_b"))


# --- JOI-1 / JOI-2 (with Q4: threshold after lists) -------------------------------------------

_LISTS_SQL = """
WITH le AS (SELECT DISTINCT list_name, entry FROM list_entries),
ev AS (SELECT event_id, domain, score, is_dga, severity,
              CASE WHEN len(string_split(domain, '.')) >= 2
                   THEN array_to_string(string_split(domain, '.')[-2:], '.') ELSE domain END AS reg FROM dns_events),
a AS (SELECT ev.*,
        CASE WHEN domain IN ('ththre.example.com') OR reg IN ('ththre.example.com') THEN 'static'
             WHEN EXISTS (SELECT 1 FROM le WHERE list_name IN ('whitelist:auto', 'whitelist:static')
                          AND (entry = ev.domain OR entry = ev.reg)) THEN 'dynamic' END AS allow_src,
        CASE WHEN domain IN ('spam-farm.example.org') OR reg IN ('spam-farm.example.org') THEN 'static'
             WHEN EXISTS (SELECT 1 FROM le WHERE list_name IN ('blacklist:auto', 'blacklist:static')
                          AND (entry = ev.domain OR entry = ev.reg)) THEN 'dynamic' END AS deny_src
      FROM ev)"""


@register("allowlist", _LISTS_SQL + """
SELECT event_id, CASE WHEN allow_src IS NOT NULL THEN false ELSE is_dga END AS is_dga,
       CASE WHEN allow_src IS NOT NULL THEN 0.0 ELSE score END AS score, severity,
       coalesce('whitelist:' || allow_src, '') AS rules
FROM a""")
def allowlist(spark, sf):
    out = RU.allowlist(_ev(spark, sf), static=["ththre.example.com"], lists=fx.list_entries(spark, sf))
    return out.select("event_id", "is_dga", "score", "severity", F.array_join("rules_applied", ",").alias("rules"))


@register("denylist", _LISTS_SQL + """
SELECT event_id, CASE WHEN deny_src IS NOT NULL THEN true ELSE is_dga END AS is_dga,
       CASE WHEN deny_src IS NOT NULL THEN 1.0 ELSE score END AS score,
       CASE WHEN deny_src IS NOT NULL THEN 'CRITICAL' ELSE severity END AS severity,
       coalesce('blacklist:' || deny_src, '') AS rules
FROM a""")
def denylist(spark, sf):
    out = RU.denylist(_ev(spark, sf), static=["spam-farm.example.org"], lists=fx.list_entries(spark, sf))
    return out.select("event_id", "is_dga", "score", "severity", F.array_join("rules_applied", ",").alias("rules"))


@register("lists_then_threshold", _LISTS_SQL + """,
b AS (SELECT event_id, CASE WHEN deny_src IS NOT NULL THEN 1.0 WHEN allow_src IS NOT NULL THEN 0.0 ELSE score END AS s,
             concat_ws(',', 'whitelist:' || allow_src, 'blacklist:' || deny_src) AS r FROM a)
SELECT event_id, s >= 0.7 AS is_dga, s AS score,
       CASE WHEN s >= 0.95 THEN 'CRITICAL' WHEN s >= 0.85 THEN 'HIGH' WHEN s >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       CASE WHEN r = '' THEN 'threshold:0.7' ELSE r || ',threshold:0.7' END AS rules
FROM b""")
def lists_then_threshold(spark, sf):
    lists = fx.list_entries(spark, sf)
    ev = RU.allowlist(_ev(spark, sf), ["ththre.example.com"], lists)
    ev = RU.denylist(ev, ["spam-farm.example.org"], lists)
    ev = RU.apply_threshold(ev, 0.7)
    return ev.select("event_id", "is_dga", "score", "severity", F.array_join("rules_applied", ",").alias("rules"))


@register("union_lists", """
SELECT DISTINCT entry FROM list_entries WHERE list_name IN ('whitelist:auto', 'whitelist:static')""")
def union_lists(spark, sf):
    return RU.list_members(fx.list_entries(spark, sf), RU.ALLOW_LISTS)


# --- JOI-3 ----------------------------------------------------------------------------------

@register("list_match_exact", """
SELECT event_id, domain IN (SELECT entry FROM list_entries WHERE list_name = 'blacklist:auto') AS list_hit
FROM dns_events""")
def list_match_exact(spark, sf):
    lst = fx.list_entries(spark, sf).where(F.col("list_name") == "blacklist:auto")
    return RU.list_match(_ev(spark, sf), lst, "exact", "pass").select("event_id", "list_hit")


_SUFFIX_LIST = """(SELECT DISTINCT entry FROM list_entries
   WHERE list_name = 'blacklist:auto'
   UNION SELECT 'example.org')"""


@register("list_match_suffix", f"""
WITH l AS {_SUFFIX_LIST},
d AS (SELECT DISTINCT domain FROM dns_events),
s AS (SELECT domain, array_to_string(list_slice(string_split(domain, '.'), i, len(string_split(domain, '.'))), '.') AS sfx
      FROM d, range(1, 128) t(i) WHERE i <= len(string_split(domain, '.'))),
h AS (SELECT DISTINCT domain FROM s WHERE sfx IN (SELECT entry FROM l))
SELECT event_id, domain IN (SELECT domain FROM h) AS list_hit FROM dns_events""")
def list_match_suffix(spark, sf):
    le = fx.list_entries(spark, sf).where(F.col("list_name") == "blacklist:auto")
    lst = le.select("entry").unionByName(
        spark.range(1).select(F.lit("example.org").alias("entry")))
    return RU.list_match(_ev(spark, sf), lst, "suffix", "pass").select("event_id", "list_hit")


@register("list_match_anti", f"""
WITH l AS {_SUFFIX_LIST},
d AS (SELECT DISTINCT domain FROM dns_events),
s AS (SELECT domain, array_to_string(list_slice(string_split(domain, '.'), i, len(string_split(domain, '.'))), '.') AS sfx
      FROM d, range(1, 128) t(i) WHERE i <= len(string_split(domain, '.'))),
h AS (SELECT DISTINCT domain FROM s WHERE sfx IN (SELECT entry FROM l))
SELECT event_id, domain FROM dns_events WHERE domain NOT IN (SELECT domain FROM h)""")
def list_match_anti(spark, sf):
    le = fx.list_entries(spark, sf).where(F.col("list_name") == "blacklist:auto")
    lst = le.select("entry").unionByName(
        spark.range(1).select(F.lit("example.org").alias("entry")))
    return RU.list_match(_ev(spark, sf), lst, "suffix", "drop").select("event_id", "domain")


@register("list_match_regex", """
SELECT event_id, regexp_matches(domain, '(?:^blog\\.)|(?:-farm\\.)|(?:^m\\..*\\.net$)') AS list_hit FROM dns_events""")
def list_match_regex(spark, sf):
    return RU.list_match(_ev(spark, sf), [r"^blog\.", r"-farm\.", r"^m\..*\.net$"], "regex", "pass").select(
        "event_id", "list_hit")


# --- JOI-4 ----------------------------------------------------------------------------------

@register("ioc_match", """
WITH d AS (SELECT entry, list_sort(list_distinct(list(source))) AS s, list_sort(list_distinct(list(tag))) AS t
           FROM domain_iocs GROUP BY entry),
i AS (SELECT entry, list_sort(list_distinct(list(source))) AS s, list_sort(list_distinct(list(tag))) AS t
      FROM ip_iocs GROUP BY entry),
j AS (SELECT e.event_id, d.entry IS NOT NULL OR i.entry IS NOT NULL AS blacklisted,
             list_distinct(list_concat(coalesce(d.s, []), coalesce(i.s, []))) AS srcs,
             list_concat(coalesce(d.t, []), coalesce(i.t, [])) AS tags
      FROM dns_events e LEFT JOIN d ON e.domain = d.entry LEFT JOIN i ON e.src_ip = i.entry)
SELECT event_id, blacklisted, CAST(len(srcs) AS INTEGER) AS source_count,
       CASE WHEN blacklisted AND len(srcs) >= 2 THEN 'critical' WHEN blacklisted THEN 'high' ELSE 'low' END AS threat_level,
       CASE WHEN blacklisted AND len(srcs) >= 2 THEN 0.95 WHEN blacklisted THEN 0.80 ELSE 0.60 END AS intel_confidence,
       array_to_string(list_sort(srcs), ',') AS sources, array_to_string(list_sort(list_distinct(tags)), ',') AS tags
FROM j""")
def ioc_match(spark, sf):
    out = RU.ioc_match(_ev(spark, sf), fx.domain_iocs(spark, sf), fx.ip_iocs(spark, sf))
    return out.select("event_id", "blacklisted", "source_count", "threat_level", "intel_confidence",
                      F.array_join(F.array_sort("ioc_sources"), ",").alias("sources"),
                      F.array_join(F.array_sort("ioc_tags"), ",").alias("tags"))


# --- JOI-8 / JOI-9 / JOI-10 / JOI-11 ------------------------------------------------------------

@register("known_feed", """
WITH b AS (SELECT DISTINCT domain FROM labelled_v WHERE family = 'alexa' AND length(domain) % 2 = 0),
f AS (SELECT domain, min(family) AS family FROM labelled_v WHERE family <> 'alexa' AND length(domain) % 3 = 0 GROUP BY 1)
SELECT l.domain, CASE WHEN b.domain IS NOT NULL THEN 'allowlist' WHEN f.domain IS NOT NULL THEN 'feed' ELSE 'model' END AS stage,
       CASE WHEN b.domain IS NOT NULL THEN false WHEN f.domain IS NOT NULL THEN true END AS feed_is_dga,
       CASE WHEN b.domain IS NULL AND f.domain IS NOT NULL THEN f.family END AS feed_family
FROM labelled_v l LEFT JOIN b ON l.domain = b.domain LEFT JOIN f ON l.domain = f.domain""")
def known_feed(spark, sf):
    lab = fx.labelled_v(spark, sf)
    benign = lab.where((F.col("family") == "alexa") & (F.length("domain") % 2 == 0)).select("domain")
    feed = lab.where((F.col("family") != "alexa") & (F.length("domain") % 3 == 0)).select("domain", "family")
    return RU.known_feed(lab.select("domain"), benign, feed)


@register("geo_enrich", """
SELECT e.event_id, g.country, g.city, g.asn, coalesce(g.country IN ('ALGERIA', 'BRAZIL'), false) AS geo_high_risk
FROM dns_events e LEFT JOIN geo_ranges g ON e.ip_long BETWEEN g.start_ip AND g.end_ip""")
def geo_enrich(spark, sf):
    out = RU.geo_enrich(_ev(spark, sf), fx.geo_ranges(spark, sf), "ip_long", high_risk=("ALGERIA", "BRAZIL"))
    return out.select("event_id", "country", "city", "asn", "geo_high_risk")


@register("intel_enrich_fail_open", """
SELECT e.event_id, i.reputation, i.malware_family FROM dns_events e LEFT JOIN intel i ON e.domain = i.domain""")
def intel_enrich_fail_open(spark, sf):
    return RU.intel_enrich(_ev(spark, sf), fx.intel(spark, sf)).select("event_id", "reputation", "malware_family")


@register("intel_enrich_fail_closed", """
SELECT e.event_id, i.reputation, i.malware_family FROM dns_events e JOIN intel i ON e.domain = i.domain""")
def intel_enrich_fail_closed(spark, sf):
    return RU.intel_enrich(_ev(spark, sf), fx.intel(spark, sf), fail_open=False).select(
        "event_id", "reputation", "malware_family")


@register("name_pipelines", """
SELECT a.pipeline_id, CAST(a.n AS BIGINT) AS n, coalesce(p.name, substr(a.pipeline_id, 1, 8)) AS name
FROM (SELECT pipeline_id, count(*) AS n FROM dns_events WHERE pipeline_id IS NOT NULL GROUP BY 1) a
LEFT JOIN pipelines_v p ON p.id = a.pipeline_id""")
def name_pipelines(spark, sf):
    agg = _ev(spark, sf).where(F.col("pipeline_id").isNotNull()).groupBy("pipeline_id").agg(
        F.count(F.lit(1)).cast("long").alias("n"))
    return RU.name_pipelines(agg, fx.pipelines_v(spark))


# --- SNK-4 / SNK-7 / SNK-8 / SNK-9 ------------------------------------------------------------------

@register("sink_condition", """
SELECT event_id, true AS always, coalesce(score, 0.0) >= 0.7 AS score_threshold, coalesce(is_dga, false) AS dga,
       severity IN ('CRITICAL', 'HIGH') AS high_severity, coalesce(is_dga, false) AS other
FROM dns_events""")
def sink_condition(spark, sf):
    ev = _ev(spark, sf)
    return ev.select("event_id", RU.sink_condition("always").alias("always"),
                     RU.sink_condition("score_threshold").alias("score_threshold"),
                     RU.sink_condition("is_dga").alias("dga"),
                     RU.sink_condition("high_severity").alias("high_severity"),
                     RU.sink_condition("anything").alias("other"))


@register("route", """
SELECT event_id, 'olap' AS target FROM dns_events WHERE severity IN ('CRITICAL', 'HIGH')
UNION ALL SELECT event_id, 'kafka' FROM dns_events WHERE coalesce(is_dga, false)
UNION ALL SELECT event_id, 'es' FROM dns_events WHERE NOT (severity IN ('CRITICAL', 'HIGH')) AND NOT coalesce(is_dga, false)""")
def route(spark, sf):
    out = RU.route(_ev(spark, sf), ["olap:high_severity", "kafka:is_dga"], default="es")
    return out.select("event_id", "target")


@register("score_route", """
SELECT event_id, CASE WHEN coalesce(score, 0.0) >= 0.7 THEN 'enrich' ELSE 'archive' END AS branch FROM dns_events""")
def score_route(spark, sf):
    return RU.score_route(_ev(spark, sf), 0.7, "enrich", "archive").select("event_id", "branch")


@register("gateway_store", """
SELECT event_id, false AS acknowledged, 'gateway' AS pipeline_id,
       CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM dns_events WHERE coalesce(is_dga, false) OR score >= 0.7""")
def gateway_store(spark, sf):
    return RU.gateway_store(_ev(spark, sf)).select("event_id", "acknowledged", "pipeline_id", "severity")


# --- SCA-12 / SCA-13 / SCA-16 / SCA-17 ---------------------------------------------------------------

@register("ensemble_score", """
SELECT doc_id, CASE WHEN pred = 1 AND prob >= 0.5 THEN 'fam' || CAST(doc_id % 3 AS VARCHAR) END AS family,
       round(CASE WHEN pred = 1 AND prob >= 0.5 THEN least(1.0, prob * 0.6 + ((doc_id % 10) / 10.0) * 0.4)
             ELSE prob END, 6) AS score, pred = 1 AS is_dga
FROM pred_v""")
def ensemble_score(spark, sf):
    p = fx.pred_v(spark, sf).select("doc_id", F.col("pred").alias("label"), F.col("prob").alias("p"),
                                    F.concat(F.lit("fam"), (F.col("doc_id") % 3).cast("string")).alias("top_family"),
                                    ((F.col("doc_id") % 10) / 10.0).alias("top_confidence"))
    out = RU.ensemble_score(p, threshold=0.5)
    return out.select("doc_id", "family", r6(F.col("score")).alias("score"), "is_dga")


@register("risk_aggregate", """
SELECT e.event_id, round(e.score * 0.4 + coalesce(i.reputation, 0) * 0.3 + (CASE WHEN e.query_type = 'TXT' THEN 1.0 ELSE 0.0 END) * 0.3, 6) AS weighted,
       round(greatest(e.score, coalesce(i.reputation, 0), CASE WHEN e.query_type = 'TXT' THEN 1.0 ELSE 0.0 END), 6) AS mx,
       round(1 - (1 - e.score) * (1 - coalesce(i.reputation, 0)) * (1 - CASE WHEN e.query_type = 'TXT' THEN 1.0 ELSE 0.0 END), 6) AS bayes
FROM dns_events e LEFT JOIN intel i ON e.domain = i.domain""")
def risk_aggregate(spark, sf):
    ev = RU.intel_enrich(_ev(spark, sf), fx.intel(spark, sf))
    geo = F.when(F.col("query_type") == "TXT", 1.0).otherwise(0.0)
    return ev.select("event_id",
                     r6(RU.risk_aggregate(F.col("score"), F.col("reputation"), geo, "weighted_sum")).alias("weighted"),
                     r6(RU.risk_aggregate(F.col("score"), F.col("reputation"), geo, "max")).alias("mx"),
                     r6(RU.risk_aggregate(F.col("score"), F.col("reputation"), geo, "bayesian")).alias("bayes"))


@register("response_actions", """
WITH plan(severity, pos, action) AS (VALUES ('CRITICAL', 0, 'block_dns'), ('CRITICAL', 1, 'isolate_host'),
  ('CRITICAL', 2, 'create_incident'), ('CRITICAL', 3, 'log_event'), ('HIGH', 0, 'block_dns'), ('HIGH', 1, 'isolate_host'),
  ('HIGH', 2, 'log_event'), ('MEDIUM', 0, 'block_dns'), ('MEDIUM', 1, 'log_event'), ('LOW', 0, 'log_event'))
SELECT e.event_id, p.action,
  CASE WHEN p.action = 'isolate_host' THEN e.src_ip WHEN p.action = 'log_event' THEN
       CASE WHEN coalesce(e.domain, '') <> '' THEN e.domain ELSE e.src_ip END ELSE e.domain END AS target,
  CASE WHEN p.action = 'block_dns' THEN e.severity = 'CRITICAL' WHEN p.action = 'isolate_host' THEN false ELSE true END AS auto_execute,
  CASE p.action WHEN 'block_dns' THEN 'urgent' WHEN 'isolate_host' THEN 'urgent' WHEN 'create_incident' THEN 'high' ELSE 'medium' END AS level
FROM dns_events e JOIN plan p ON p.severity = e.severity WHERE e.is_dga""")
def response_actions(spark, sf):
    out = RU.response_actions(_ev(spark, sf).where("is_dga"))
    return out.select("event_id", "action", "target", "auto_execute", "level")


@register("classify_intent", """
SELECT conv_id, turn,
  CASE WHEN text LIKE '%查询%' OR text LIKE '%统计%' OR text LIKE '%趋势%' OR text LIKE '%多少%' OR text LIKE '%数量%' THEN 'query'
       WHEN text LIKE '%分析%' OR text LIKE '%解释%' OR text LIKE '%告警%' OR text LIKE '%检测%' OR text LIKE '%评估%' THEN 'analyze'
       WHEN text LIKE '%配置%' OR text LIKE '%设置%' OR text LIKE '%修改%' OR text LIKE '%更新%' OR text LIKE '%部署%' THEN 'operate'
       WHEN text LIKE '%什么是%' OR text LIKE '%如何%' OR text LIKE '%知识%' OR text LIKE '%家族%' OR text LIKE '%特征%' THEN 'knowledge'
       ELSE 'query' END AS intent
FROM conversations""")
def classify_intent(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", RU.classify_intent(F.col("text"))["intent"].alias("intent"))
