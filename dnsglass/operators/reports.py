"""Dashboard and report aggregations over stored events.

Every operator is one scan with partial aggregation; window choices that the
reference made with repeated queries and fallbacks are made here in the same
pass (conditional counts) and picked with a one-row join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import as_of_lit
from .common import top_k, top_k_per_group


def _days_ago(as_of, days: int):
    return as_of_lit(as_of) - F.make_dt_interval(days=F.lit(days))


def _one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row (broadcast of 1 row)."""
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


# --- AGG-4 / AGG-5 / AGG-31 ---------------------------------------------------------

def dashboard_window_flags(as_of=None):
    now = as_of_lit(as_of)
    return {
        "today": F.col("event_date") == F.to_date(now),
        "h24": F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"),
        "d30": F.col("ts") >= now - F.expr("INTERVAL 30 DAYS"),
    }


def dashboard_choice(df: DataFrame, as_of=None) -> DataFrame:
    """One row: the chosen window (today's partition, else last 24 h, else 30 d)
    with its total and DGA hits, computed in one pass over the events."""
    fl = dashboard_window_flags(as_of)
    dga = F.col("is_dga") == F.lit(True)
    s = df.agg(*[F.count_if(c).alias(f"n_{k}") for k, c in fl.items()],
               *[F.count_if(c & dga).alias(f"h_{k}") for k, c in fl.items()])
    win = F.when(F.col("n_today") > 0, "today").when(F.col("n_h24") > 0, "24h").otherwise("30d")
    pick = lambda p: (F.when(F.col("n_today") > 0, F.col(f"{p}_today"))
                      .when(F.col("n_h24") > 0, F.col(f"{p}_h24")).otherwise(F.col(f"{p}_d30")))
    return s.select(win.alias("window"), pick("n").alias("total"), pick("h").alias("dga_hits"))


def p95_estimate(total) -> "F.Column":
    t = F.col(total) if isinstance(total, str) else total
    est = F.round(F.greatest(F.lit(8.0), F.least(F.lit(200.0), F.lit(5000.0) / F.greatest(t, F.lit(1)))), 1)
    return F.when(t > 0, est).otherwise(F.lit(0.0))


def dashboard_counts(df: DataFrame, as_of=None) -> DataFrame:
    c = dashboard_choice(df, as_of)
    return c.select(
        "window", F.col("total").cast("long").alias("total"),
        F.col("dga_hits").cast("long").alias("dga_hits"),
        F.round(F.col("dga_hits") / F.greatest(F.col("total"), F.lit(1)) * 100, 2).alias("hit_rate"),
        p95_estimate(F.col("total")).alias("p95_latency"))


def family_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """Terms count on family (missing family ignored), count desc, key asc."""
    g = df.where(F.col("family").isNotNull()).groupBy("family").agg(F.count(F.lit(1)).alias("value"))
    return top_k(g, [F.desc("value"), F.asc("family")], n).select(
        F.col("family").alias("name"), F.col("value").cast("long").alias("value"))


def dashboard_families(df: DataFrame, as_of=None, n: int = 10) -> DataFrame:
    """Family top-n inside the dashboard's chosen window (same single pass)."""
    fl = dashboard_window_flags(as_of)
    g = (df.where(F.col("family").isNotNull()).groupBy("family")
         .agg(*[F.count_if(c).alias(f"f_{k}") for k, c in fl.items()]))
    g = _one_row_join(g, dashboard_choice(df, as_of).select("window"))
    v = (F.when(F.col("window") == "today", F.col("f_today"))
         .when(F.col("window") == "24h", F.col("f_h24")).otherwise(F.col("f_d30")))
    g = g.select("family", v.alias("value")).where(F.col("value") > 0)
    return top_k(g, [F.desc("value"), F.asc("family")], n).select(
        F.col("family").alias("name"), F.col("value").cast("long").alias("value"))


# --- AGG-6 ---------------------------------------------------------------------------------

# Fallback levels (look-back, bucket, max points, label format)
QPS_LEVELS = [
    (1, "60 minutes", "minute", 60, "HH:mm"),
    (2, "24 hours", "hour", 24, "HH:00"),
    (3, "7 days", "hour", 168, "MM-dd HH:00"),
    (4, "30 days", "day", 30, "yyyy-MM-dd"),
]


def qps_history(df: DataFrame, as_of=None) -> DataFrame:
    """Date-histogram counts and DGA hits; the first level with a non-empty
    bucket wins; empty buckets dropped; last `limit` buckets; label per level."""
    now = as_of_lit(as_of)
    arms = []
    for lvl, back, unit, _, _ in QPS_LEVELS:
        arms.append(F.when(F.col("ts") >= now - F.expr(f"INTERVAL {back}"),
                           F.struct(F.lit(lvl).alias("level"),
                                    F.date_trunc(unit, "ts").alias("bucket"))))
    ex = df.select(F.explode(F.filter(F.array(*arms), lambda x: x.isNotNull())).alias("b"),
                   (F.col("is_dga") == F.lit(True)).alias("dga"))
    g = ex.groupBy(F.col("b.level").alias("level"), F.col("b.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("qps"), F.count_if("dga").alias("hits"))
    first = g.agg(F.min("level").alias("chosen"))
    g = _one_row_join(g, first).where(F.col("level") == F.col("chosen"))
    lim = F.lit(0)
    fmt = None
    for lvl, _, _, limit, pattern in QPS_LEVELS:
        lim = F.when(F.col("level") == lvl, F.lit(limit)).otherwise(lim)
        lab = F.date_format("bucket", pattern)
        fmt = F.when(F.col("level") == lvl, lab) if fmt is None else fmt.when(F.col("level") == lvl, lab)
    g = g.withColumn("limit", lim)
    g = top_k_per_group(g, ["level"], [F.desc("bucket")], 168, "_r").where(F.col("_r") <= F.col("limit"))
    return g.select("level", "bucket", fmt.alias("time"), F.col("qps").cast("long").alias("qps"),
                    F.col("hits").cast("long").alias("hits"))


# --- AGG-7 ---------------------------------------------------------------------------------

def daily_trend(df: DataFrame, start=None, end=None, days: int | None = 7, as_of=None) -> DataFrame:
    """Per-UTC-day total and DGA count, dense between first and last day."""
    f = df
    if start is not None or end is not None:
        if start is not None:
            f = f.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            f = f.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    elif days is not None:
        f = f.where(F.col("ts") >= _days_ago(as_of, days))
    daily = f.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_dga") == F.lit(True)).alias("dga"))
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    days_df = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    out = days_df.join(daily, "day", "left")
    return out.select("day", F.date_format("day", "M/d").alias("date"),
                      F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                      F.coalesce("dga", F.lit(0)).cast("long").alias("dga"))


# --- AGG-8 / AGG-9 / WIN-1 -------------------------------------------------------------------

def rank_rows(df: DataFrame, order_cols) -> DataFrame:
    """1-based `rank` and 0-based `key` over a (small, already top-k) result."""
    from pyspark.sql import Window
    w = Window.orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("key", F.col("rank") - 1)


def top_domains(df: DataFrame, n: int = 10) -> DataFrame:
    g = (df.where(F.col("is_dga") == F.lit(True)).where(F.col("domain").isNotNull())
         .groupBy("domain").agg(F.count(F.lit(1)).alias("count")))
    t = top_k(g, [F.desc("count"), F.asc("domain")], n)
    # rank over at most n rows (after the limit): a single tiny partition is fine
    return rank_rows(t, [F.desc("count"), F.asc("domain")]).select(
        "rank", "key", "domain", F.col("count").cast("long").alias("count"), F.lit("").alias("family"))


def top_hosts(df: DataFrame, n: int = 10) -> DataFrame:
    d = df.where(F.col("is_dga") == F.lit(True)).where(F.col("src_ip").isNotNull())
    # two-level aggregation: (src_ip, domain) then src_ip -> exact distinct count
    pair = d.groupBy("src_ip", "domain").agg(F.count(F.lit(1)).alias("n"))
    g = pair.groupBy("src_ip").agg(F.sum("n").alias("alerts"),
                                   F.count("domain").alias("unique_domains"))
    t = top_k(g, [F.desc("alerts"), F.asc("src_ip")], n)
    return rank_rows(t, [F.desc("alerts"), F.asc("src_ip")]).select(
        "rank", "key", "src_ip", F.col("alerts").cast("long").alias("alerts"),
        F.col("unique_domains").cast("long").alias("unique_domains"))


# --- AGG-10 ----------------------------------------------------------------------------------

def heatmap(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Dense 24 x 7 (hour, weekday Monday=0) counts, zero-filled: 168 rows."""
    spark = spark or df.sparkSession
    counts = df.groupBy(F.hour("ts").alias("hour"), F.expr("weekday(ts)").alias("weekday")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = spark.range(168).select((F.col("id") / 7).cast("int").alias("hour"),
                                   (F.col("id") % 7).cast("int").alias("weekday"))
    return grid.join(counts, ["hour", "weekday"], "left").select(
        "hour", "weekday", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# --- AGG-11 ----------------------------------------------------------------------------------

def pipeline_stats(events: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Long-format rows (section, name, value): status counts, DGA alerts by
    pipeline (with display name) / family / severity, and alert_rate."""
    from .rules import name_pipelines
    st = pipelines.groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("value"))
    status = st.select(F.lit("status").alias("section"), F.col("status").alias("name"), "value")
    total = pipelines.agg(F.count(F.lit(1)).alias("total"))
    # the three top lists are counted in one pass over the events
    keys = ("pipeline_id", "family", "severity")
    counts = events.where(F.col("is_dga") == F.lit(True)).groupingSets([(k,) for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("n"), *[(F.grouping(k) == 0).alias(f"_{k}") for k in keys])
    section = F.when(F.col("_pipeline_id"), "pipeline").when(F.col("_family"), "family").otherwise("severity")
    counts = counts.select(section.alias("section"), F.coalesce(*keys).alias("name"), "n").where("name is not null")
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), F.asc("name"))))
    listed = ranked.where(F.col("_r") <= F.when(F.col("section") == "severity", 5).otherwise(10)).where("_r <= 10")
    byp = listed.where("section = 'pipeline'").select(F.col("name").alias("pipeline_id"), "n")
    named = name_pipelines(byp, pipelines)
    by_pipe = named.select(F.lit("pipeline").alias("section"),
                           F.concat_ws("|", "pipeline_id", "name").alias("name"),
                           F.col("n").cast("double").alias("value"))
    others = listed.where("section <> 'pipeline'").select("section", "name", F.col("n").cast("double").alias("value"))
    with_alerts = byp.agg(F.count(F.lit(1)).alias("k"))
    rate = _one_row_join(with_alerts, total).select(
        F.lit("summary").alias("section"), F.lit("alert_rate").alias("name"),
        F.round(F.col("k") / F.greatest(F.col("total"), F.lit(1)) * 100, 1).alias("value"))
    tot = total.select(F.lit("summary").alias("section"), F.lit("total").alias("name"),
                       F.col("total").cast("double").alias("value"))
    return status.unionByName(by_pipe).unionByName(others).unionByName(rate).unionByName(tot)


# --- AGG-12 ----------------------------------------------------------------------------------

def alert_summary(df: DataFrame, start=None, n_sev: int = 20, n_fam: int = 50) -> DataFrame:
    """DGA-only severity x family counts: top-20 severities, top-50 families each."""
    d = df.where(F.col("is_dga") == F.lit(True))
    if start is not None:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    d = d.where(F.col("severity").isNotNull())
    sev = top_k(d.groupBy("severity").agg(F.count(F.lit(1)).alias("ns")),
                [F.desc("ns"), F.asc("severity")], n_sev)
    sf = (d.where(F.col("family").isNotNull()).groupBy("severity", "family")
          .agg(F.count(F.lit(1)).alias("count")).join(sev.select("severity"), "severity", "left_semi"))
    t = top_k_per_group(sf, ["severity"], [F.desc("count"), F.asc("family")], n_fam, "_r")
    return t.select("severity", "family", F.col("count").cast("long").alias("count"))


# --- AGG-22 ----------------------------------------------------------------------------------

def top_domains_daily(df: DataFrame) -> DataFrame:
    """(stat_date, domain) -> hits, avg/max score, sorted family list, distinct src_ips."""
    # one scan: the distinct addresses are grouped map-side by (date, domain, src_ip), a
    # family list holds at most the known families
    d = df.where(F.col("domain").isNotNull())
    out = d.groupBy(F.to_date("ts").alias("stat_date"), "domain").agg(
        F.count(F.lit(1)).alias("hit_count"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct("src_ip").alias("src_ip_count"))
    return out.select("stat_date", "domain", F.col("hit_count").cast("long").alias("hit_count"),
                      "avg_score", "max_score", F.coalesce("families", F.lit("")).alias("families"),
                      F.coalesce("src_ip_count", F.lit(0)).cast("long").alias("src_ip_count"))
