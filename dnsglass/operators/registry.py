"""Model-version table operators: A/B routing, promotion, weights, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import as_of_lit
from ..functions.domain import ab_ratio

METRICS_SCHEMA = T.StructType([T.StructField(k, T.DoubleType())
                               for k in ("accuracy", "f1", "precision", "recall", "auc")])


def cumulative_weight(versions: DataFrame) -> DataFrame:
    """Running share of the A/B weights per model, in `id` order."""
    w = Window.partitionBy("model_id").orderBy("id")
    run = F.sum("ab_weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tot = F.sum("ab_weight").over(Window.partitionBy("model_id"))
    return versions.withColumn("cum_share", run / tot)


def route_model_version(df: DataFrame, versions: DataFrame, model_id: str,
                        trace_col: str = "trace_id") -> DataFrame:
    """Deterministic weighted A/B: md5 ratio of the trace id against the
    cumulative weights of the production versions (in id order).
    0 versions -> null, 1 -> it, total weight 0 -> first, else first version
    whose cumulative share exceeds the ratio, else the last.

    The production versions of one model are a handful of rows: they are
    folded into one sorted array (one row) and broadcast; events never shuffle.
    """
    prod = versions.where((F.col("model_id") == model_id) & (F.col("status") == "production"))
    one = prod.agg(F.array_sort(F.collect_list(F.struct("id", "version", "ab_weight"))).alias("vs"))
    tot = F.aggregate(F.col("vs"), F.lit(0.0), lambda a, v: a + v["ab_weight"])
    # running cumulative share per position
    cum = F.transform(F.col("vs"), lambda v, i: F.struct(
        v["version"].alias("version"),
        F.aggregate(F.slice(F.col("vs"), 1, i + 1), F.lit(0.0), lambda a, x: a + x["ab_weight"] / tot).alias("hi")))
    one = one.select("vs", cum.alias("cum"), tot.alias("tot"))
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    r = ab_ratio(F.col(trace_col))
    n = F.size("vs")
    first_hit = F.element_at(F.filter(F.col("cum"), lambda c: r < c["hi"]), 1)["version"]
    chosen = (F.when(n == 0, F.lit(None).cast("string"))
              .when(n == 1, F.element_at("vs", 1)["version"])
              .when(F.col("tot") == 0, F.element_at("vs", 1)["version"])
              .otherwise(F.coalesce(first_hit, F.element_at("vs", -1)["version"])))
    return out.withColumn("ab_ratio", r).withColumn("routed_version", chosen).drop("_one", "vs", "cum", "tot")


def promote_version(versions: DataFrame, model_id: str, action: str, to_version: str | None = None,
                    now: str | None = None) -> DataFrame:
    """Next snapshot after deploy / rollback / offline of one model."""
    cur = (F.col("model_id") == model_id) & (F.col("status") == "production")
    tgt = (F.col("model_id") == model_id) & (F.col("version") == F.lit(to_version))
    ts = as_of_lit(now)
    if action == "deploy":
        status = F.when(tgt, "production").when(cur, "staging").otherwise(F.col("status"))
        dep = F.when(tgt, ts).otherwise(F.col("deployed_at"))
    elif action == "rollback":
        status = F.when(tgt, "production").when(cur, "archived").otherwise(F.col("status"))
        dep = F.when(tgt, ts).otherwise(F.col("deployed_at"))
    elif action == "offline":
        status = F.when(cur, "staging").otherwise(F.col("status"))
        dep = F.when(cur, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("deployed_at"))
    else:
        raise ValueError(action)
    # both new values are computed from the old row in one projection
    others = [c for c in versions.columns if c not in ("status", "deployed_at")]
    return versions.select(*others, status.alias("status"), dep.alias("deployed_at")).select(*versions.columns)


def set_ab_weights(versions: DataFrame, model_id: str | None = None, weights: dict | None = None,
                   version_a: str | None = None, version_b: str | None = None,
                   weight_a: float | None = None) -> DataFrame:
    """By (model, version) map, or a / 1-a by version string across all models."""
    w = F.col("ab_weight")
    if weights is not None:
        for v, x in weights.items():
            w = F.when((F.col("model_id") == model_id) & (F.col("version") == v), F.lit(float(x))).otherwise(w)
    else:
        w = (F.when(F.col("version") == version_b, F.lit(1.0 - weight_a))
             .when(F.col("version") == version_a, F.lit(float(weight_a))).otherwise(w))
    return versions.withColumn("ab_weight", w)


def model_performance(versions: DataFrame, n: int = 20) -> DataFrame:
    m = F.from_json("metrics", METRICS_SCHEMA)
    out = versions.select("model_id", "version", "status", m.alias("m"), "created_at")
    out = out.orderBy(F.desc("created_at"), F.desc("version"), F.asc("model_id")).limit(n)
    return out.select("model_id", "version", "status", *[F.col(f"m.{k}").alias(k) for k in
                                                          ("accuracy", "f1", "precision", "recall", "auc")],
                      "created_at")
