"""Population Stability Index drift monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feedback import cooldown

# Fixed values (must equal the reference)
DRIFT_THRESHOLD_WARN = 0.10
DRIFT_THRESHOLD_ALERT = 0.25
DRIFT_COOLDOWN_HOURS = 6
MIN_WINDOW = 100
CLIP = 1e-6


def _long(df: DataFrame, features: list[str], side: str) -> DataFrame:
    """Unpivot feature columns into (feature, value, side); absent -> 0.0."""
    st = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                      F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value"))
                             for f in features]))
    return df.select(st.alias("s")).select("s.feature", "s.value", F.lit(side).alias("side"))


def psi(baseline: DataFrame, current: DataFrame, features: list[str], bins: int = 10,
        min_window: int = MIN_WINDOW) -> DataFrame:
    """PSI per feature with equal-width bins on the joint min / max.

    One unpivoted scan feeds three aggregates (joint extremes, per-bin counts,
    per-side totals); all are per-feature / per-bin sized.  Features whose
    current window holds fewer than `min_window` rows are not scored."""
    long = _long(baseline, features, "e").unionByName(_long(current, features, "a"))
    ext = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                      F.count_if(F.col("side") == "e").alias("n_e"),
                                      F.count_if(F.col("side") == "a").alias("n_a"))
    ext = ext.where((F.col("n_a") >= min_window) & (F.col("n_e") > 0))
    # per-feature extremes are a handful of rows: broadcast them to the scan
    j = long.join(F.broadcast(ext), "feature")
    idx = F.least(((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
    cnt = j.where(F.col("hi") > F.col("lo")).groupBy("feature", idx.alias("bin")).agg(
        F.count_if(F.col("side") == "e").alias("c_e"), F.count_if(F.col("side") == "a").alias("c_a"))
    grid = ext.select("feature", "lo", "hi", "n_e", "n_a", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = grid.join(cnt, ["feature", "bin"], "left")
    e = F.greatest(F.coalesce(F.col("c_e"), F.lit(0)) / F.col("n_e"), F.lit(CLIP))
    a = F.greatest(F.coalesce(F.col("c_a"), F.lit(0)) / F.col("n_a"), F.lit(CLIP))
    term = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((a - e) * F.log(a / e))
    return g.groupBy("feature").agg(F.sum(term).alias("psi"), F.first("n_a").alias("window_size"))


def drift_grade(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c >= DRIFT_THRESHOLD_ALERT, "ALERT").when(c >= DRIFT_THRESHOLD_WARN, "WARN").otherwise("none"))


def drift_alerts(scores: DataFrame, ops: DataFrame | None = None, as_of=None) -> DataFrame:
    """ALERT-grade features become pending drift_alert operations, except
    features with a pending drift_alert in the last 6 hours."""
    a = scores.withColumn("grade", drift_grade("psi")).where(F.col("grade") == "ALERT")
    if ops is not None:
        a = cooldown(a, ops, "feature", "feature", "drift_alert", f"{DRIFT_COOLDOWN_HOURS} HOURS", as_of)
    detail = F.to_json(F.struct("feature", F.round("psi", 4).alias("psi"),
                                F.lit(DRIFT_THRESHOLD_ALERT).alias("threshold"), "window_size"))
    return a.select(F.lit("default").alias("pipeline_id"), F.lit("drift_alert").alias("operation"),
                    F.lit("drift-monitor").alias("operator"), F.lit("pending").alias("status"),
                    "feature", "psi", detail.alias("detail"))
