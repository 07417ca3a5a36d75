"""Alert search, grouped alerts, statistics, paging and acknowledgement.

Inputs are event DataFrames in the stored-event schema (`schema.EVENT_SCHEMA`).
All predicates are plain Columns, so they reach the Parquet scan as pushed
filters; time bounds also emit an `event_date` predicate for partition pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_of_lit, rank_to_severity, severity_rank
from .common import conj, top_k, top_k_per_group


# --- FLT-5 ----------------------------------------------------------------------

def alert_predicate(severity=None, family=None, acknowledged=None, domain=None, src_ip=None,
                    source=None, pipeline_id=None, score_min=None, score_max=None,
                    start=None, end=None, domain_wildcards: bool = False,
                    partition_col: str | None = "event_date") -> Column:
    """Conjunction of the optional alert filters (none -> all rows)."""
    p: list[Column] = []
    if severity:
        p.append(F.col("severity") == severity)
    if family:
        p.append(F.col("family") == family)
    if acknowledged is not None:
        p.append(F.col("acknowledged") == F.lit(bool(acknowledged)))
    if domain:
        if domain_wildcards:  # '*' and '?' act as wildcards, case-sensitive
            pat = domain.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
            p.append(F.col("domain").like(f"%{pat}%"))
        else:
            p.append(F.col("domain").contains(domain))
    if src_ip:
        p.append(F.col("src_ip") == src_ip)
    if source == "manual":
        p.append(F.col("pipeline_id").isNull() | (F.col("pipeline_id") == "gateway"))
    elif source == "dag":
        p.append(F.col("pipeline_id").isNotNull() & (F.col("pipeline_id") != "gateway"))
    if pipeline_id:
        p.append(F.col("pipeline_id") == pipeline_id)
    if score_min is not None:
        p.append(F.col("score") >= F.lit(float(score_min)))
    if score_max is not None:
        p.append(F.col("score") <= F.lit(float(score_max)))
    if start is not None:
        s = F.lit(start).cast("timestamp_ntz")
        p.append(F.col("ts") >= s)
        if partition_col:
            p.append(F.col(partition_col) >= F.to_date(s))
    if end is not None:
        e = F.lit(end).cast("timestamp_ntz")
        p.append(F.col("ts") <= e)
        if partition_col:
            p.append(F.col(partition_col) <= F.to_date(e))
    return conj(p)


def alert_filter(df: DataFrame, **kw) -> DataFrame:
    if "event_date" not in df.columns:
        kw.setdefault("partition_col", None)
    return df.where(alert_predicate(**kw))


# --- FLT-11 ---------------------------------------------------------------------

def alert_listing(df: DataFrame) -> DataFrame:
    """10-column projection with the listing defaults."""
    return df.select(
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("family", F.lit("")).alias("family"),
        F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.col("ts").alias("timestamp"),
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.coalesce("is_dga", F.lit(True)).alias("is_dga"),
        F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"),
        F.coalesce("pipeline_id", F.lit("")).alias("pipeline_id"),
    )


# --- AGG-1 / AGG-2 ------------------------------------------------------------------

def alerts_by_domain(df: DataFrame, size: int = 200, top_ips: int = 10) -> DataFrame:
    """Alerts grouped by domain.

    Plan, without a partition by domain of anything but aggregates:
    1. totals by domain (count, rank maximum, score maximum, first / last seen,
       unacknowledged count) are mergeable sums, combined map-side; the top `size`
       domains by count are all that stays (TakeOrderedAndProject);
    2. the events of these domains (a broadcast semi-join of at most `size` names) are
       counted by (domain, src_ip) and by (domain, family) in one pass of grouping sets, so
       a hot domain is spread over the tasks by its addresses;
    3. the `top_ips` busiest addresses (count desc, ip asc) and the most frequent family
       (count desc, name asc) of each domain are limited map-side before a shuffle, the
       number of addresses is a sum of ones;
    4. final order (count, severity rank) desc, domain asc.
    """
    from pyspark.sql import Window
    named = df.where(F.col("domain").isNotNull())
    totals = named.groupBy("domain").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max(severity_rank("severity")).alias("sev_rank"), F.max("score").alias("max_score"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("acknowledged") == F.lit(False)).alias("unack"))
    top = top_k(totals, [F.desc("alert_count"), F.asc("domain")], size)
    mine = named.select("domain", "src_ip", "family").join(F.broadcast(top.select("domain")), "domain", "left_semi")
    counts = mine.groupingSets([("domain", "src_ip"), ("domain", "family")], "domain", "src_ip", "family").agg(
        F.count(F.lit(1)).alias("n"), (F.grouping("src_ip") == 0).alias("is_ip"))
    counts = counts.select("domain", "is_ip", F.when(F.col("is_ip"), F.col("src_ip")).otherwise(F.col("family")).alias("value"), "n").where("value is not null")
    order = Window.partitionBy("domain", "is_ip").orderBy(F.desc("n"), F.asc("value"))
    first = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.lit(top_ips))
    best = first.groupBy("domain").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_ip"), F.struct("r", "value")))).alias("ips"),
        F.max(F.when(~F.col("is_ip") & (F.col("r") == 1), F.col("value"))).alias("family"))
    ips = counts.where("is_ip").groupBy("domain").agg(F.count(F.lit(1)).alias("ip_count"))
    out = top.join(F.broadcast(best), "domain", "left").join(F.broadcast(ips), "domain", "left")  # at most `size` rows each
    return out.select(
        "domain", F.col("alert_count").cast("long").alias("alert_count"),
        F.coalesce(F.transform("ips", lambda x: x["value"]), F.array().cast("array<string>")).alias("unique_src_ips"),
        F.coalesce("ip_count", F.lit(0)).cast("long").alias("unique_src_ip_count"),
        F.coalesce(rank_to_severity(F.col("sev_rank")), F.lit("LOW")).alias("max_severity"),
        "max_score", "family", "first_seen", "last_seen",
        (F.col("unack") == 0).alias("all_acknowledged"),
    ).orderBy(F.desc("alert_count"), F.desc(severity_rank("max_severity")), F.asc("domain"))


def unique_domain_count(df: DataFrame, exact: bool = True) -> DataFrame:
    d = F.col("domain")
    agg = F.count_distinct(d) if exact else F.approx_count_distinct(d)
    return df.agg(agg.cast("long").alias("total_unique_domains"))


# --- AGG-3 -------------------------------------------------------------------------

def alert_stats(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """total, pending, acknowledged and yesterday counts in one pass, with the
    severity distribution (top 10) as rows `(metric='severity:<name>')`."""
    now = as_of_lit(as_of)
    today = F.date_trunc("day", now)
    yday = today - F.expr("INTERVAL 1 DAY")
    scal = df.agg(
        F.count("event_id").alias("total"),
        F.count_if(F.col("acknowledged") == F.lit(False)).alias("pending"),
        F.count_if(F.col("acknowledged") == F.lit(True)).alias("acknowledged"),
        F.count_if((F.col("ts") >= yday) & (F.col("ts") < today)).alias("total_yesterday"))
    scal = scal.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value"))
        for k in ("total", "pending", "acknowledged", "total_yesterday")])).alias("m")).select("m.*")
    sev = top_k(df.where(F.col("severity").isNotNull()).groupBy("severity")
                .agg(F.count(F.lit(1)).alias("value")),
                [F.desc("value"), F.asc("severity")], 10)
    sev = sev.select(F.concat(F.lit("severity:"), F.col("severity")).alias("metric"),
                     F.col("value").cast("long").alias("value"))
    return scal.unionByName(sev)


# --- SRT-1 / FLT-13 / FLT-14 / SRT-2 / SRT-3 --------------------------------------------

def page(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first, `offset` + `limit`, with the filtered total on every row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(F.desc("ts"), F.asc("event_id")).offset(offset).limit(limit)
    # `total` is one row by construction: broadcast hash join on a constant key
    one = F.broadcast(total.withColumn("_one", F.lit(1)))
    return rows.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def get_event(df: DataFrame, event_id: str) -> DataFrame:
    return df.where(F.col("event_id") == event_id).limit(1)


def related_alerts(df: DataFrame, event_ids: DataFrame, n: int = 5) -> DataFrame:
    """For each requested event: the n newest other alerts sharing its non-empty
    src_ip.  `event_ids` is a request batch (column `event_id`).

    The newest n+1 events per src_ip are cut first (row_number <= n+1, limited
    map-side), so the join fans out to at most n+1 rows per anchor even when
    one source IP owns a third of all events; no pair list is ever built.
    """
    cand = df.where(F.coalesce(F.col("src_ip"), F.lit("")) != "").select(
        "event_id", "domain", "score", "severity", "ts", "src_ip")
    newest = top_k_per_group(cand, ["src_ip"], [F.desc("ts"), F.asc("event_id")], n + 1, "_r")
    anchor = (df.join(event_ids.select("event_id").distinct(), "event_id", "left_semi")
              .where(F.coalesce(F.col("src_ip"), F.lit("")) != "")
              .select(F.col("event_id").alias("anchor_id"), F.col("src_ip").alias("a_ip")))
    pairs = (newest.join(anchor, newest.src_ip == anchor.a_ip)
             .where(F.col("event_id") != F.col("anchor_id")).drop("a_ip", "_r"))
    return top_k_per_group(pairs, ["anchor_id"], [F.desc("ts"), F.asc("event_id")], n)


def high_score_feed(df: DataFrame, min_score: float = 0.7, n: int = 50) -> DataFrame:
    """Newest n events with score >= min_score, emitted oldest -> newest."""
    newest = top_k(df.where(F.col("score") >= min_score), [F.desc("ts"), F.desc("event_id")], n)
    return newest.orderBy(F.asc("ts"), F.asc("event_id"))


def recent_dga(df: DataFrame, n: int = 30) -> DataFrame:
    newest = top_k(df.where(F.col("is_dga") == F.lit(True)), [F.desc("ts"), F.asc("event_id")], n)
    return newest.select(
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("family", F.lit("unknown")).alias("family"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.col("ts").alias("timestamp"))


def threat_report(df: DataFrame, start=None, end=None, n: int = 100, min_score: float = 0.7) -> DataFrame:
    f = df.where((F.col("is_dga") == F.lit(True)) & (F.col("score") >= min_score))
    f = alert_filter(f, start=start, end=end)
    return top_k(f, [F.desc("score"), F.desc("ts"), F.asc("event_id")], n).select(
        "event_id", "domain", "score", "family", "severity", "src_ip", "ts")


# --- UPD-1 --------------------------------------------------------------------------------

def acknowledge(df: DataFrame, domains: DataFrame | None = None,
                event_ids: DataFrame | None = None) -> DataFrame:
    """Next snapshot of the events with acknowledged set, plus `updated` flag.

    By domain: only rows whose domain is listed AND acknowledged = false change
    (a second run updates 0).  By event id: unconditional.  Request lists have no
    bound, so the planner picks the join by their size.
    """
    cond = F.lit(False)
    out = df
    if domains is not None:
        d = domains.select(F.col("domain").alias("_ack_d")).distinct()
        out = out.join(d, out.domain == d._ack_d, "left")
        cond = cond | (F.col("_ack_d").isNotNull() & (F.col("acknowledged") == F.lit(False)))
    if event_ids is not None:
        e = event_ids.select(F.col("event_id").alias("_ack_e")).distinct()
        out = out.join(e, out.event_id == e._ack_e, "left")
        cond = cond | F.col("_ack_e").isNotNull()
    out = out.withColumn("updated", F.coalesce(cond, F.lit(False)))
    out = out.withColumn("acknowledged", F.when(F.col("updated"), F.lit(True))
                         .otherwise(F.col("acknowledged")))
    return out.drop(*[c for c in ("_ack_d", "_ack_e") if c in out.columns])
