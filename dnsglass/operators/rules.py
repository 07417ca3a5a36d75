"""Detection rules as joins and column expressions: allow / deny lists,
list matching, IOC, geo and intel enrichment, tenant thresholds, severity,
routing conditions and the small scoring rules.

Join sides: list / feed / IOC tables are de-duplicated on their key before the
join so no event row can fan out; no hint is placed on them, so the planner
broadcasts them when their statistics are under
`spark.sql.autoBroadcastJoinThreshold` and falls back to a sort-merge join
beyond it.  Explicit broadcasts are used only for inputs bounded by
construction (tenant maps and static lists become literals; one-row frames).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import registered_domain
from ..schema import DEFAULT_THRESHOLD, severity_scale

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference)
# ---------------------------------------------------------------------------
ALLOW_LISTS = ("whitelist:auto", "whitelist:static")
DENY_LISTS = ("blacklist:auto", "blacklist:static")
SEVERITY_ACTIONS = {
    "CRITICAL": ["block_dns", "isolate_host", "create_incident", "log_event"],
    "HIGH": ["block_dns", "isolate_host", "log_event"],
    "MEDIUM": ["block_dns", "log_event"],
    "LOW": ["log_event"],
}
ACTION_LEVEL = {"block_dns": "urgent", "isolate_host": "urgent",
                "create_incident": "high", "log_event": "medium"}
INTENT_KEYWORDS = [
    ("query", ["查询", "统计", "趋势", "多少", "数量"]),
    ("analyze", ["分析", "解释", "告警", "检测", "评估"]),
    ("operate", ["配置", "设置", "修改", "更新", "部署"]),
    ("knowledge", ["什么是", "如何", "知识", "家族", "特征"]),
]
RISK_WEIGHTS = {"dga": 0.4, "intel": 0.3, "geo": 0.3}


def _append_rule(rule: Column) -> Column:
    rules = F.coalesce(F.col("rules_applied"), F.array().cast("array<string>"))
    return F.array_append(rules, rule)


def _ensure_rules(df: DataFrame) -> DataFrame:
    if "rules_applied" not in df.columns:
        df = df.withColumn("rules_applied", F.array().cast("array<string>"))
    return df


# --- JOI-1 / JOI-2 / SET-1 ------------------------------------------------------

def list_members(lists: DataFrame, names) -> DataFrame:
    """Union of several named sets -> distinct entries (SET-1)."""
    return lists.where(F.col("list_name").isin(list(names))).select("entry").distinct()


def _list_hit(df: DataFrame, static, lists: DataFrame | None, names, tag: str) -> DataFrame:
    dom = F.col("domain")
    reg = registered_domain(dom)
    static = list(static or [])
    static_hit = (dom.isin(static) | reg.isin(static)) if static else F.lit(False)
    out = df.withColumn(f"_{tag}_static", F.coalesce(static_hit, F.lit(False)))
    if lists is not None:
        m = list_members(lists, names)
        a = m.select(F.col("entry").alias(f"_{tag}_a"))
        b = m.select(F.col("entry").alias(f"_{tag}_b"))
        out = (out.join(a, dom == F.col(f"_{tag}_a"), "left")
               .join(b, reg == F.col(f"_{tag}_b"), "left"))
        dyn = F.col(f"_{tag}_a").isNotNull() | F.col(f"_{tag}_b").isNotNull()
    else:
        dyn = F.lit(False)
    out = out.withColumn(f"_{tag}_src", F.when(F.col(f"_{tag}_static"), "static")
                         .when(dyn, "dynamic"))
    return out.drop(*[c for c in (f"_{tag}_a", f"_{tag}_b", f"_{tag}_static") if c in out.columns])


def allowlist(df: DataFrame, static=None, lists: DataFrame | None = None) -> DataFrame:
    """Hit on domain or registered domain (static beats dynamic):
    is_dga=false, score=0.0, rule whitelist:<source>; severity untouched."""
    out = _list_hit(_ensure_rules(df), static, lists, ALLOW_LISTS, "allow")
    hit = F.col("_allow_src").isNotNull()
    out = (out.withColumn("is_dga", F.when(hit, F.lit(False)).otherwise(F.col("is_dga")))
           .withColumn("score", F.when(hit, F.lit(0.0)).otherwise(F.col("score")))
           .withColumn("rules_applied", F.when(hit, _append_rule(F.concat(F.lit("whitelist:"), F.col("_allow_src"))))
                       .otherwise(F.col("rules_applied"))))
    return out.drop("_allow_src")


def denylist(df: DataFrame, static=None, lists: DataFrame | None = None) -> DataFrame:
    """Hit: is_dga=true, score=1.0, severity CRITICAL, rule blacklist:<source>."""
    out = _list_hit(_ensure_rules(df), static, lists, DENY_LISTS, "deny")
    hit = F.col("_deny_src").isNotNull()
    out = (out.withColumn("is_dga", F.when(hit, F.lit(True)).otherwise(F.col("is_dga")))
           .withColumn("score", F.when(hit, F.lit(1.0)).otherwise(F.col("score")))
           .withColumn("severity", F.when(hit, F.lit("CRITICAL")).otherwise(F.col("severity")))
           .withColumn("rules_applied", F.when(hit, _append_rule(F.concat(F.lit("blacklist:"), F.col("_deny_src"))))
                       .otherwise(F.col("rules_applied"))))
    return out.drop("_deny_src")


# --- JOI-3 ------------------------------------------------------------------------

def parent_suffixes(col) -> Column:
    """All parent domains including itself: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(col if isinstance(col, Column) else F.col(col), r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def list_match(df: DataFrame, entries: DataFrame | list[str], mode: str = "exact",
               on_match: str = "tag", tag: str = "list_match") -> DataFrame:
    """mode exact | suffix | regex; on_match pass (flag only) | drop | tag.

    suffix: the distinct domains are exploded into their parent suffixes and
    equi-joined with the list, so no `LIKE '%x'` theta join exists.  regex: the
    (configuration-sized) pattern list is compiled into one alternation and
    evaluated with `rlike` per row, no join at all."""
    dom = F.col("domain")
    if mode == "regex":
        pats = entries if isinstance(entries, list) else None
        if pats is None:
            raise ValueError("regex mode takes a list of patterns")
        hit = dom.rlike("|".join(f"(?:{p})" for p in pats)) if pats else F.lit(False)
        out = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    else:
        lst = entries.select(F.col("entry").alias("_e")).distinct()
        if mode == "exact":
            hits = lst.select(F.col("_e").alias("_hd"))
        elif mode == "suffix":
            doms = df.select(dom.alias("_hd")).where(F.col("_hd").isNotNull()).distinct()
            sfx = doms.select("_hd", F.explode(parent_suffixes(F.col("_hd"))).alias("_e"))
            hits = sfx.join(lst, "_e", "left_semi").select("_hd").distinct()
        else:
            raise ValueError(f"unknown mode {mode!r}")
        out = df.join(hits, dom == F.col("_hd"), "left").withColumn("_hit", F.col("_hd").isNotNull()).drop("_hd")
    if on_match == "drop":
        return out.where(~F.col("_hit")).drop("_hit")
    if on_match == "pass":
        return out.withColumnRenamed("_hit", "list_hit")
    if on_match == "tag":
        out = _ensure_rules(out)
        return out.withColumn("rules_applied", F.when(F.col("_hit"), _append_rule(F.lit(tag)))
                              .otherwise(F.col("rules_applied"))).withColumnRenamed("_hit", "list_hit")
    raise ValueError(f"unknown on_match {on_match!r}")


# --- JOI-4 ------------------------------------------------------------------------

def _ioc_index(iocs: DataFrame, prefix: str) -> DataFrame:
    """One row per IOC entry with its sorted distinct sources and tags."""
    return iocs.groupBy(F.col("entry").alias(f"{prefix}_entry")).agg(
        F.array_sort(F.collect_set("source")).alias(f"{prefix}_sources"),
        F.array_sort(F.collect_set("tag")).alias(f"{prefix}_tags"))


def ioc_match(df: DataFrame, domain_iocs: DataFrame, ip_iocs: DataFrame) -> DataFrame:
    """Domain and IP look-ups; distinct sources count -> threat level.

    The IOC feeds are aggregated once per entry, then left-joined by key: the
    events are never grouped, so a hot domain or IP costs nothing extra."""
    d = _ioc_index(domain_iocs, "d")
    i = _ioc_index(ip_iocs, "i")
    out = (df.join(d, F.col("domain") == F.col("d_entry"), "left")
           .join(i, F.col("src_ip") == F.col("i_entry"), "left"))
    empty = F.array().cast("array<string>")
    sources = F.array_distinct(F.concat(F.coalesce("d_sources", empty), F.coalesce("i_sources", empty)))
    tags = F.array_distinct(F.concat(F.coalesce("d_tags", empty), F.coalesce("i_tags", empty)))
    n = F.size(sources)
    out = out.withColumn("ioc_sources", sources).withColumn("ioc_tags", tags)
    out = out.withColumn("blacklisted", F.col("d_entry").isNotNull() | F.col("i_entry").isNotNull())
    out = out.withColumn("source_count", F.size("ioc_sources"))
    out = out.withColumn("threat_level", F.when(F.col("blacklisted") & (n >= 2), "critical")
                         .when(F.col("blacklisted"), "high").otherwise("low"))
    out = out.withColumn("intel_confidence", F.when(F.col("threat_level") == "critical", 0.95)
                         .when(F.col("threat_level") == "high", 0.80).otherwise(0.60))
    return out.drop("d_entry", "d_sources", "d_tags", "i_entry", "i_sources", "i_tags")


# --- JOI-8 ------------------------------------------------------------------------

def known_feed(df: DataFrame, benign: DataFrame, dga_feed: DataFrame) -> DataFrame:
    """First stage before the model: benign allow list, then known-DGA feed
    (label + family), else `stage = 'model'` (falls through)."""
    b = benign.select(F.col("domain").alias("_b")).distinct()
    f = dga_feed.groupBy(F.col("domain").alias("_f")).agg(F.min("family").alias("_ff"))
    out = df.join(b, F.col("domain") == F.col("_b"), "left").join(f, F.col("domain") == F.col("_f"), "left")
    stage = F.when(F.col("_b").isNotNull(), "allowlist").when(F.col("_f").isNotNull(), "feed").otherwise("model")
    return (out.withColumn("stage", stage)
            .withColumn("feed_is_dga", F.when(F.col("stage") == "allowlist", F.lit(False))
                        .when(F.col("stage") == "feed", F.lit(True)))
            .withColumn("feed_family", F.when(F.col("stage") == "feed", F.col("_ff")))
            .drop("_b", "_f", "_ff"))


# --- JOI-9 ------------------------------------------------------------------------

def geo_enrich(df: DataFrame, ranges: DataFrame, ip_col: str = "ip_long",
               high_risk=("IRAN", "RUSSIA", "CHINA"), bucket_bits: int = 16) -> DataFrame:
    """Range join ip -> (country, city, asn).  Each distinct address is looked up once:
    ranges are exploded over the /16 buckets they cover, addresses equi-join on their
    bucket, then `between`; of overlapping ranges the narrowest counts, then the one
    that starts first.  The events join the result on their address, one row each.
    High-risk countries (config list) set `geo_high_risk`."""
    sh = 2 ** bucket_bits
    r = ranges.select(F.explode(F.sequence((F.col("start_ip") / sh).cast("long"),
                                           (F.col("end_ip") / sh).cast("long"))).alias("_bk"),
                      "start_ip", "end_ip", F.struct((F.col("end_ip") - F.col("start_ip")).alias("width"), "start_ip",
                                                     "country", "city", "asn").alias("_geo"))
    ips = df.select(F.col(ip_col).alias("_ip")).where("_ip is not null").distinct().withColumn("_bk", (F.col("_ip") / sh).cast("long"))
    best = (ips.join(r, "_bk").where(F.col("_ip").between(F.col("start_ip"), F.col("end_ip")))
            .groupBy("_ip").agg(F.min("_geo").alias("_geo")))
    j = df.join(best, F.col(ip_col) == F.col("_ip"), "left")
    j = j.select(*df.columns, F.col("_geo.country"), F.col("_geo.city"), F.col("_geo.asn"))
    return j.withColumn("geo_high_risk", F.coalesce(F.col("country").isin(list(high_risk)), F.lit(False)))


# --- JOI-10 / JOI-11 --------------------------------------------------------------

def intel_enrich(df: DataFrame, intel: DataFrame, fields=("reputation", "malware_family"),
                 fail_open: bool = True) -> DataFrame:
    """Adds a domain's intel fields; of several rows for a domain the least by its fields
    counts.  Domains without intel keep nulls (fail open) or go (fail closed)."""
    t = intel.groupBy(F.col("domain").alias("_id")).agg(F.min(F.struct(*fields)).alias("_f")).select(
        "_id", *[F.col("_f")[f].alias(f) for f in fields])
    out = df.join(t, F.col("domain") == F.col("_id"), "left" if fail_open else "inner")
    return out.drop("_id")


def name_pipelines(agg: DataFrame, pipelines: DataFrame) -> DataFrame:
    p = pipelines.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))
    out = agg.join(p, F.col("pipeline_id") == F.col("_pid"), "left")
    return out.withColumn("name", F.coalesce("_pname", F.substring("pipeline_id", 1, 8))).drop("_pid", "_pname")


# --- FLT-7 .. FLT-10 ----------------------------------------------------------------

def apply_threshold(df: DataFrame, default: float = DEFAULT_THRESHOLD, tenants: dict | None = None) -> DataFrame:
    """threshold = tenant override else default; is_dga = score >= threshold;
    severity scale A; rule `threshold:<t>`.  The tenant map is a literal."""
    t = F.lit(float(default))
    if tenants:
        m = F.create_map(*[x for k, v in tenants.items() for x in (F.lit(k), F.lit(float(v)))])
        t = F.coalesce(F.element_at(m, F.coalesce(F.col("tenant_id"), F.lit("default"))), t)
    out = _ensure_rules(df).withColumn("threshold", t)
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return (out.withColumn("is_dga", score >= F.col("threshold"))
            .withColumn("severity", severity_scale("A", score, F.col("threshold")))
            .withColumn("rules_applied", _append_rule(F.concat(F.lit("threshold:"), F.col("threshold").cast("string")))))


def threshold_action(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, action_below: str = "drop",
                     min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    s = F.col("score")
    out = df
    if min_score is not None:
        out = out.where(s >= min_score)
    if max_score is not None:
        out = out.where(s <= max_score)
    if action_below == "drop":
        return out.where(s >= threshold)
    if action_below == "pass_normal":
        return out.withColumn("verdict", F.when(s >= threshold, "alert").otherwise("normal"))
    raise ValueError(action_below)


def severity_tag(df: DataFrame, critical: float = 0.95, high: float = 0.85, medium: float = 0.7,
                 score_field: str = "score", output_field: str = "severity") -> DataFrame:
    s = F.col(score_field)
    return df.withColumn(output_field, F.when(s >= critical, "CRITICAL").when(s >= high, "HIGH")
                         .when(s >= medium, "MEDIUM").otherwise("LOW"))


# --- SNK-4 / SNK-7 / SNK-8 / SNK-9 -------------------------------------------------

def sink_condition(name: str, threshold: float | None = None) -> Column:
    if name == "always":
        return F.lit(True)
    if name in ("score_threshold", "score >= threshold"):
        return F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(DEFAULT_THRESHOLD if threshold is None else threshold)
    if name == "high_severity":
        return F.col("severity").isin("CRITICAL", "HIGH")
    return F.coalesce(F.col("is_dga"), F.lit(False))  # "is_dga" and any other name


def route(df: DataFrame, routes: list[str], default: str = "es") -> DataFrame:
    """["es:always", "kafka:is_dga", ...] -> one row per matching target."""
    arms = []
    for r in routes:
        target, _, cond = r.partition(":")
        arms.append(F.when(F.coalesce(sink_condition(cond or "always"), F.lit(False)), F.lit(target)))
    targets = F.filter(F.array(*arms), lambda x: x.isNotNull())
    targets = F.when(F.size(targets) == 0, F.array(F.lit(default))).otherwise(targets)
    return df.withColumn("target", F.explode(targets))


def score_route(df: DataFrame, threshold: float, high: str, low: str) -> DataFrame:
    return df.withColumn("branch", F.when(F.coalesce(F.col("score"), F.lit(0.0)) >= threshold, F.lit(high))
                         .otherwise(F.lit(low)))


def gateway_store(df: DataFrame) -> DataFrame:
    """Store only is_dga OR score >= .7, as the scoring gateway writes them."""
    keep = df.where(F.coalesce(F.col("is_dga"), F.lit(False)) | (F.col("score") >= 0.7))
    return (keep.withColumn("acknowledged", F.lit(False))
            .withColumn("pipeline_id", F.lit("gateway"))
            .withColumn("severity", severity_scale("B", F.col("score"))))


# --- SCA-12 / SCA-13 / SCA-16 / SCA-17 -----------------------------------------------

def ensemble_score(df: DataFrame, label: str = "label", p: str = "p", family: str = "top_family",
                   conf: str = "top_confidence", threshold: float = 0.5,
                   weights: tuple[float, float] | None = (0.6, 0.4)) -> DataFrame:
    known = (F.col(label) == 1) & (F.col(p) >= threshold) & F.col(family).isNotNull()
    fam = F.when(known, F.col(family))
    fconf = F.when(known, F.col(conf))
    score = F.col(p)
    if weights:
        score = F.when(fconf.isNotNull(), F.least(F.lit(1.0), F.col(p) * weights[0] + fconf * weights[1])).otherwise(score)
    return (df.withColumn("family", fam).withColumn("family_confidence", fconf)
            .withColumn("score", score).withColumn("is_dga", F.col(label) == 1))


def risk_aggregate(dga, intel, geo, method: str = "weighted_sum") -> Column:
    c = [F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(0.0)) for x in (dga, intel, geo)]
    if method == "weighted_sum":
        return c[0] * RISK_WEIGHTS["dga"] + c[1] * RISK_WEIGHTS["intel"] + c[2] * RISK_WEIGHTS["geo"]
    if method == "max":
        return F.greatest(*c)
    if method == "bayesian":
        return F.lit(1.0) - (F.lit(1.0) - c[0]) * (F.lit(1.0) - c[1]) * (F.lit(1.0) - c[2])
    raise ValueError(method)


def response_actions(df: DataFrame) -> DataFrame:
    """severity -> planned actions (exploded) with target, auto_execute, level."""
    plan = F.create_map(*[x for k, v in SEVERITY_ACTIONS.items()
                          for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    levels = F.create_map(*[x for k, v in ACTION_LEVEL.items() for x in (F.lit(k), F.lit(v))])
    out = df.select("*", F.posexplode(F.coalesce(F.element_at(plan, F.col("severity")),
                                                 F.array(F.lit("log_event")))).alias("action_idx", "action"))
    target = (F.when(F.col("action") == "isolate_host", F.col("src_ip"))
              .when(F.col("action") == "log_event",
                    F.when(F.coalesce(F.col("domain"), F.lit("")) != "", F.col("domain")).otherwise(F.col("src_ip")))
              .otherwise(F.col("domain")))
    auto = (F.when(F.col("action") == "block_dns", F.col("severity") == "CRITICAL")
            .when(F.col("action") == "isolate_host", F.lit(False)).otherwise(F.lit(True)))
    return (out.withColumn("target", target).withColumn("auto_execute", auto)
            .withColumn("level", F.coalesce(F.element_at(levels, F.col("action")), F.lit("medium"))))


def classify_intent(col, keyword_map=None) -> Column:
    """struct(intent, confidence): first category (in the map's order) any of whose
    keywords occurs, confidence .6; else `query` with .3.  `keyword_map` is a list of
    (intent, keywords), by default the fixed one."""
    intent, conf = intent_of(col, keyword_map)
    return F.struct(intent.alias("intent"), conf.alias("confidence"))


def intent_of(col, keyword_map=None) -> tuple[Column, Column]:
    c = F.col(col) if isinstance(col, str) else col
    hit_any = None
    intent = None
    for name, kws in keyword_map or INTENT_KEYWORDS:
        cond = None
        for kw in kws:
            cond = c.contains(kw) if cond is None else cond | c.contains(kw)
        intent = F.when(cond, F.lit(name)) if intent is None else intent.when(cond, F.lit(name))
        hit_any = cond if hit_any is None else hit_any | cond
    return intent.otherwise(F.lit("query")), F.when(hit_any, F.lit(0.6)).otherwise(F.lit(0.3))
