"""Labelled-corpus statistics (family counts, length histogram, box-plot
quantiles, character distribution) and windowed metric queries (P95, rates,
sustained breaches)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BENIGN_FAMILY
from .common import exact_percentile, top_k


def _dga(df: DataFrame) -> DataFrame:
    return df.where(F.col("family") != BENIGN_FAMILY)


# --- AGG-24 ----------------------------------------------------------------------------

def family_counts(df: DataFrame) -> DataFrame:
    return _dga(df).groupBy("family").agg(F.count(F.lit(1)).cast("long").alias("count"))


def class_counts(df: DataFrame) -> DataFrame:
    cls = F.when(F.col("family") == BENIGN_FAMILY, "benign").otherwise("dga")
    return df.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).cast("long").alias("count"))


# --- AGG-25 ----------------------------------------------------------------------------

def length_histogram(df: DataFrame, bins: int = 30, dga_only: bool = True) -> DataFrame:
    """Equal-width histogram of trimmed domain length (numpy semantics: the
    last bin is closed; equal min and max widen the range by .5 each side)."""
    d = _dga(df) if dga_only else df
    d = d.select(F.length(F.trim("domain")).cast("double").alias("len"))
    ext = d.agg(F.min("len").alias("mn"), F.max("len").alias("mx"))
    ext = ext.select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    j = d.withColumn("_one", F.lit(1)).join(F.broadcast(ext.withColumn("_one", F.lit(1))), "_one")
    b = F.least(F.floor((F.col("len") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    cnt = j.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ext.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(cnt, "bin", "left")
    width = (F.col("hi") - F.col("lo")) / bins
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("edge_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("edge_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# --- AGG-26 ----------------------------------------------------------------------------

def length_quantiles(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Box-plot statistics of domain length for the top-n DGA families.
    `percentile` keeps one counter per distinct length (<= 253), so its state
    stays small however many domains a family has."""
    d = _dga(df).select("family", F.length(F.trim("domain")).alias("len"))
    top = top_k(d.groupBy("family").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("family")], top_n)
    q = d.join(top.select("family"), "family", "left_semi").groupBy("family").agg(
        F.percentile("len", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"), F.count(F.lit(1)).cast("long").alias("n"))
    return q.select("family", "n", *[F.col("q")[i].alias(k) for i, k in
                                     enumerate(["min", "q1", "median", "q3", "max"])])


# --- AGG-27 ----------------------------------------------------------------------------

def char_distribution(df: DataFrame, by: str = "dga", family: str | None = None) -> DataFrame:
    """a-z frequency of lower-cased domains: all DGA ('dga'), benign, or one family."""
    if by == "dga":
        d = _dga(df)
    elif by == "benign":
        d = df.where(F.col("family") == BENIGN_FAMILY)
    else:
        d = df.where(F.col("family") == family)
    # per-row character counts first (map-side), then a 26-key aggregate
    chars = F.explode(F.split(F.lower("domain"), ""))
    c = d.where(F.col("domain").isNotNull()).select(chars.alias("char")).where(F.col("char").rlike("^[a-z]$"))
    g = c.groupBy("char").agg(F.count(F.lit(1)).cast("long").alias("count"))
    tot = g.agg(F.sum("count").alias("_tot"))
    return g.withColumn("_one", F.lit(1)).join(F.broadcast(tot.withColumn("_one", F.lit(1))), "_one") \
        .select("char", "count", (F.col("count") / F.col("_tot")).alias("freq"))


# --- AGG-28 / AGG-29 / AGG-30 ------------------------------------------------------------------

def latency_quantile(df: DataFrame, value: str, label: str, bucket: str = "1 day", q: float = 0.95,
                     exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """P-q per (window, label).  Default `percentile_approx` (bounded sketch per
    group); `exact=True` gives the exact interpolated percentile through
    grouped running totals, so a hot (window, label) group is never held in
    one task."""
    d = df.select(F.window("ts", bucket).start.alias("window_start"), F.col(label).alias("label"), F.col(value))
    if exact:
        out = exact_percentile(d, ["window_start", "label"], value, q)
        return out.withColumnRenamed("percentile", "p")
    return d.groupBy("window_start", "label").agg(F.percentile_approx(value, q, accuracy).alias("p"))


def windowed_rate(df: DataFrame, window: str = "5 minutes", slide: str | None = None, by: str = "event_type",
                  window_seconds: int = 300) -> DataFrame:
    """Events per second per label and (sliding) window, with error / hit ratios."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = df.groupBy(w.alias("w"), F.col(by).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_nx") == F.lit(True)).alias("errors"),
        F.count_if(F.col("is_dga") == F.lit(True)).alias("hits"))
    return g.select(F.col("w.start").alias("window_start"), "label", F.col("n").cast("long").alias("n"),
                    (F.col("n") / window_seconds).alias("rate"), (F.col("errors") / F.col("n")).alias("error_ratio"),
                    (F.col("hits") / F.col("n")).alias("hit_ratio"))


def sustained_breach(metric: DataFrame, value: str, op: str, limit: float, for_buckets: int,
                     key: str = "label", t: str = "window_start", bucket_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive buckets where `value op limit` holds, kept when the
    run lasts at least `for_buckets` buckets (gaps-and-islands: a run id is the
    bucket index minus the running count of breaching buckets).  The metric
    table has one row per (label, bucket), so the per-label window is small."""
    cmp = {">": F.col(value) > limit, ">=": F.col(value) >= limit, "<": F.col(value) < limit}[op]
    idx = F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({t} as timestamp_ntz))")
                  / bucket_seconds)
    b = metric.where(cmp).withColumn("_i", idx)
    w = Window.partitionBy(key).orderBy("_i")
    b = b.withColumn("_run", F.col("_i") - F.row_number().over(w))
    runs = b.groupBy(key, "_run").agg(F.min(t).alias("start"), F.max(t).alias("last"),
                                      F.count(F.lit(1)).alias("buckets"), F.max(value).alias("peak"))
    return runs.where(F.col("buckets") >= for_buckets).select(
        key, "start", "last", F.col("buckets").cast("long").alias("buckets"), "peak")
