"""Registered queries: model evaluation, registry snapshots and spark.ml
training / inference (the latter as rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import AS_OF as CLOCK
from .. import fixtures as fx
from ..operators import ml as ML
from ..operators import registry as RG
from .catalog import r6, register


@register("classification_metrics", """
WITH s AS (SELECT truth AS t, pred AS p, count(*) AS n FROM pred_v GROUP BY 1, 2),
cls AS (SELECT truth AS cls FROM pred_v UNION SELECT pred FROM pred_v),
j AS (SELECT c.cls, coalesce((SELECT sum(n) FROM s WHERE t = c.cls AND p = c.cls), 0) AS tp,
             coalesce((SELECT sum(n) FROM s WHERE t = c.cls), 0) AS support,
             coalesce((SELECT sum(n) FROM s WHERE p = c.cls), 0) AS predicted FROM cls c)
SELECT CAST(cls AS VARCHAR) AS cls, CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp,
       CAST(predicted - tp AS BIGINT) AS fp, CAST(support - tp AS BIGINT) AS fn,
       round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
       round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
       round(CASE WHEN predicted > 0 AND support > 0 AND tp > 0 THEN 2 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support) ELSE 0 END, 6) AS f1
FROM j
UNION ALL SELECT 'accuracy', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE truth = pred) AS BIGINT), NULL, NULL,
       round(count(*) FILTER (WHERE truth = pred) / count(*), 6), round(count(*) FILTER (WHERE truth = pred) / count(*), 6),
       round(count(*) FILTER (WHERE truth = pred) / count(*), 6) FROM pred_v""")
def classification_metrics(spark, sf):
    out = ML.classification_metrics(fx.pred_v(spark, sf))
    return out.select("cls", "support", "tp", "fp", "fn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("confusion_matrix", """
SELECT truth, CAST(count(*) FILTER (WHERE pred = 0) AS BIGINT) AS "0", CAST(count(*) FILTER (WHERE pred = 1) AS BIGINT) AS "1"
FROM pred_v GROUP BY truth""")
def confusion_matrix(spark, sf):
    out = ML.confusion_matrix(fx.pred_v(spark, sf))
    return out.select("truth", F.col("0").cast("long").alias("0"), F.col("1").cast("long").alias("1"))


_ROC = """WITH g AS (SELECT prob AS threshold, count(*) FILTER (WHERE truth = 1) AS pos,
                  count(*) FILTER (WHERE truth <> 1) AS neg FROM pred_v GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
             sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g),
r AS (SELECT threshold, cum_pos AS tp, cum_neg AS fp, CASE WHEN P > 0 THEN cum_pos / P ELSE 0 END AS tpr,
             CASE WHEN N > 0 THEN cum_neg / N ELSE 0 END AS fpr,
             CASE WHEN P > 0 AND N > 0 THEN neg * (2 * cum_pos - pos) / (2.0 * N * P) ELSE 0 END AS auc_part FROM c)"""


@register("roc_curve", _ROC + """
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(auc_part, 6) AS auc_part FROM r""")
def roc_curve(spark, sf):
    out = ML.roc_curve(fx.pred_v(spark, sf))
    return out.select("threshold", "tp", "fp", *[r6(F.col(c)).alias(c) for c in ("tpr", "fpr", "auc_part")])


@register("roc_auc", _ROC + " SELECT round(sum(auc_part), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return ML.roc_auc(fx.pred_v(spark, sf)).select(r6(F.col("auc")).alias("auc"))


# --- registry snapshots (MLP-10..12, JOI-7) ------------------------------------------------------

_MV = "id, model_id, version, status, ab_weight, deployed_at"


@register("promote_version_deploy", f"""
SELECT id, model_id, version,
  CASE WHEN model_id = 'binary' AND version = 'v1.0' THEN 'production'
       WHEN model_id = 'binary' AND status = 'production' THEN 'staging' ELSE status END AS status,
  ab_weight, CASE WHEN model_id = 'binary' AND version = 'v1.0' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE deployed_at END AS deployed_at
FROM model_versions_v""")
def promote_version_deploy(spark, sf):
    return RG.promote_version(fx.model_versions_v(spark, sf), "binary", "deploy", "v1.0", now=CLOCK).select(*_MV.split(", "))


@register("promote_version_rollback", """
SELECT id, model_id, version,
  CASE WHEN model_id = 'family' AND version = 'v1.0' THEN 'production'
       WHEN model_id = 'family' AND status = 'production' THEN 'archived' ELSE status END AS status,
  ab_weight, CASE WHEN model_id = 'family' AND version = 'v1.0' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE deployed_at END AS deployed_at
FROM model_versions_v""")
def promote_version_rollback(spark, sf):
    return RG.promote_version(fx.model_versions_v(spark, sf), "family", "rollback", "v1.0", now=CLOCK).select(*_MV.split(", "))


@register("promote_version_offline", """
SELECT id, model_id, version, CASE WHEN model_id = 'family' AND status = 'production' THEN 'staging' ELSE status END AS status,
  ab_weight, CASE WHEN model_id = 'family' AND status = 'production' THEN NULL ELSE deployed_at END AS deployed_at
FROM model_versions_v""")
def promote_version_offline(spark, sf):
    return RG.promote_version(fx.model_versions_v(spark, sf), "family", "offline", now=CLOCK).select(*_MV.split(", "))


@register("set_ab_weights_by_model", """
SELECT id, model_id, version, CASE WHEN model_id = 'family' AND version = 'v1.0' THEN 0.5
  WHEN model_id = 'family' AND version = 'v1.1' THEN 0.5 ELSE ab_weight END AS ab_weight FROM model_versions_v""")
def set_ab_weights_by_model(spark, sf):
    out = RG.set_ab_weights(fx.model_versions_v(spark, sf), "family", {"v1.0": 0.5, "v1.1": 0.5})
    return out.select("id", "model_id", "version", "ab_weight")


@register("set_ab_weights_by_version", """
SELECT id, model_id, version, CASE WHEN version = 'v1.1' THEN 0.3 WHEN version = 'v1.0' THEN 0.7 ELSE ab_weight END AS ab_weight
FROM model_versions_v""")
def set_ab_weights_by_version(spark, sf):
    out = RG.set_ab_weights(fx.model_versions_v(spark, sf), version_a="v1.0", version_b="v1.1", weight_a=0.7)
    return out.select("id", "model_id", "version", r6(F.col("ab_weight")).alias("ab_weight"))


@register("model_performance", """
SELECT model_id, version, status, CAST(json_extract_string(metrics, '$.accuracy') AS DOUBLE) AS accuracy,
       CAST(json_extract_string(metrics, '$.f1') AS DOUBLE) AS f1, CAST(json_extract_string(metrics, '$.precision') AS DOUBLE) AS precision,
       CAST(json_extract_string(metrics, '$.recall') AS DOUBLE) AS recall, CAST(json_extract_string(metrics, '$.auc') AS DOUBLE) AS auc,
       created_at
FROM model_versions_v ORDER BY created_at DESC, version DESC, model_id LIMIT 20""")
def model_performance(spark, sf):
    return RG.model_performance(fx.model_versions_v(spark, sf), 20)


@register("route_model_version", """
WITH v AS (SELECT id, version, ab_weight FROM model_versions_v WHERE model_id = 'family' AND status = 'production'),
c AS (SELECT version, sum(ab_weight) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) / sum(ab_weight) OVER () AS hi, id FROM v),
e AS (SELECT trace_id, CAST(('0x' || substr(md5(trace_id), 1, 8)) AS BIGINT) / 4294967295.0 AS r FROM dns_events)
SELECT e.trace_id, round(e.r, 6) AS ab_ratio,
       coalesce((SELECT version FROM c WHERE e.r < c.hi ORDER BY id LIMIT 1),
                (SELECT version FROM c ORDER BY id DESC LIMIT 1)) AS routed_version
FROM e""")
def route_model_version(spark, sf):
    out = RG.route_model_version(fx.dns_events(spark, sf), fx.model_versions_v(spark, sf), "family")
    return out.select("trace_id", r6(F.col("ab_ratio")).alias("ab_ratio"), "routed_version")


# --- spark.ml (rows-only checks) -------------------------------------------------------------------

def _lab(spark, sf):
    return fx.labelled_v(spark, sf)


#: Models of this process by application, table folder and kind, with their scored test split.
_trained: dict = {}


def _once(spark, sf, train):
    """The model that `train` makes of the labelled table with its own defaults, and the
    scored test split: trained once, used by all queries on that table."""
    # a changed table is another table: its files' times and sizes are part of the key
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/part.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf, train.__name__, status.getModificationTime(), status.getLen())
    if key not in _trained:
        _trained[key] = train(_lab(spark, sf))
    return _trained[key]


@register("train_binary")
def train_binary(spark, sf):
    _, scored = _once(spark, sf, ML.train_binary)
    return scored.select("domain", "label", vector_to_array_p("probability"), F.col("prediction"))


def vector_to_array_p(col):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(col)[1].alias("p")


@register("score_binary")
def score_binary(spark, sf):
    model, _ = _once(spark, sf, ML.train_binary)
    return ML.score_binary(fx.dns_events(spark, sf).select("event_id", "domain"), model).select(
        "event_id", "domain", "label_pred", "p")


@register("cross_validate")
def cross_validate(spark, sf):
    return ML.cross_validate(_lab(spark, sf))


@register("train_family")
def train_family(spark, sf):
    _, scored = _once(spark, sf, ML.train_family)
    return scored.select("domain", "family", "prediction")


@register("classify_family")
def classify_family(spark, sf):
    model, _ = _once(spark, sf, ML.train_family)
    out = ML.classify_family(_lab(spark, sf).select("domain"), model, top_k=3, min_confidence=0.3, only_dga=False)
    return out.select("domain", F.explode_outer("top_families").alias("t")).select("domain", "t.family", "t.confidence")


@register("score_two_stage")
def score_two_stage(spark, sf):
    b, _ = _once(spark, sf, ML.train_binary)
    f, _ = _once(spark, sf, ML.train_family)
    ev = fx.dns_events(spark, sf).select("event_id", "domain")
    return ML.score_two_stage(ev, b, f).select("event_id", "domain", "score", "is_dga", "family", "family_confidence")


@register("pca_ngrams")
def pca_ngrams(spark, sf):
    return ML.pca_ngrams(_lab(spark, sf).select("domain", "family"), 2, "family")


def _test_split_sql(where):
    return f"""
SELECT domain, target, family FROM labelled_v
WHERE {where} AND CAST('0x' || substr(md5('42:' || coalesce(domain, '')), 1, 8) AS UBIGINT) % 10000 >= 7000"""


@register("binary_test_split", _test_split_sql("true"))
def binary_test_split(spark, sf):
    """The rows that `train_binary` scores, with their labels."""
    return ML.hash_split(_lab(spark, sf))[1]


@register("family_test_split", _test_split_sql("family <> 'alexa'"))
def family_test_split(spark, sf):
    """The rows that `train_family` scores, with their labels."""
    from ..schema import BENIGN_FAMILY
    return ML.hash_split(_lab(spark, sf).where(F.col("family") != BENIGN_FAMILY))[1]


@register("score_udf", "SELECT event_id, domain, length(domain) / 253.0 AS udf_score FROM dns_events")
def score_udf(spark, sf):
    def load():
        def model(s):
            return s.str.len().astype("float64") / 253.0
        return model
    udf = ML.score_udf(load, "double")
    return fx.dns_events(spark, sf).select("event_id", "domain", udf(F.col("domain")).alias("udf_score"))


# --- JOI-16: audit trail of one model (audit rows derived from the version table) ---------------

def _audit(spark, sf):
    mv = fx.model_versions_v(spark, sf)
    reg = mv.select(F.lit("model_register").alias("action"), F.col("model_id").alias("resource_id"),
                    F.col("version").alias("detail"), F.col("created_at"))
    dep = mv.where(F.col("deployed_at").isNotNull()).select(
        F.lit("model_deploy").alias("action"), F.col("model_id").alias("resource_id"),
        F.col("version").alias("detail"), F.col("deployed_at").alias("created_at"))
    other = mv.select(F.lit("pipeline_update").alias("action"), F.col("model_id").alias("resource_id"),
                      F.col("version").alias("detail"), F.col("created_at"))
    return reg.unionByName(dep).unionByName(other)


@register("model_history", """
WITH a AS (SELECT 'model_register' AS action, model_id AS resource_id, version AS detail, created_at FROM model_versions_v
  UNION ALL SELECT 'model_deploy', model_id, version, deployed_at FROM model_versions_v WHERE deployed_at IS NOT NULL
  UNION ALL SELECT 'pipeline_update', model_id, version, created_at FROM model_versions_v)
SELECT * FROM a WHERE action LIKE 'model_%' AND resource_id = 'family'""")
def model_history(spark, sf):
    from ..operators.ops import model_history as op
    return op(_audit(spark, sf), "family")
