"""Message parsing, validation, feature maps, de-duplication and the score
cache (FLT-1, FLT-2, FLT-12, FLT-15, SCA-8, SCA-19, SET-3, SET-5, JOI-15, AGG-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.domain import cache_key, feature_map, is_valid_domain, normalize_domain, split_parts
from ..schema import SEVERITIES
from .common import top_k

DEFAULT_FIELDS = ["query_name", "query_type", "src_ip", "timestamp"]
CACHE_TTL_SECONDS = 300


def parse_dns(df: DataFrame, fields: list[str] | None = None, raw_col: str = "raw") -> DataFrame:
    """FLT-1: JSON object -> the configured fields (missing -> ''); text ->
    whitespace split, positional; domain / src_ip / query_type / event_timestamp
    from the parsed fields; query_type defaults to 'A' only when it is not a
    configured field (Q6); `parsed` keeps the configured map."""
    fields = fields or DEFAULT_FIELDS
    raw = F.col(raw_col)
    obj = F.from_json(raw, T.MapType(T.StringType(), T.StringType()))
    is_obj = F.trim(raw).startswith("{") & obj.isNotNull()
    parts = F.split(F.trim(raw), r"\s+")
    vals = []
    for i, f in enumerate(fields):
        from_json = F.coalesce(F.element_at(obj, F.lit(f)), F.lit(""))
        from_text = F.coalesce(F.get(parts, i), F.lit(""))
        vals.append(F.when(is_obj, from_json).otherwise(from_text))
    parsed = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*vals))
    out = df.withColumn("parsed", parsed)

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.element_at(F.col("parsed"), F.lit(name)), F.lit(default)) if name in fields else F.lit(default)
    return (out.withColumn("domain", field("query_name", ""))
            .withColumn("src_ip", field("src_ip", ""))
            .withColumn("query_type", field("query_type", "A"))
            .withColumn("event_timestamp", field("timestamp", "")))


def validate_domains(df: DataFrame, col: str = "domain", lower: bool = True) -> DataFrame:
    """FLT-2: trim (+ lower), drop empty / > 253 / illegal characters."""
    d = normalize_domain(F.col(col)) if lower else F.trim(F.col(col))
    out = df.withColumn(col, d)
    return out.where(is_valid_domain(F.col(col)))


EVENT_CONTRACT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("trace_id", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("src_ip", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("is_dga", T.BooleanType()), T.StructField("family", T.StringType()),
    T.StructField("family_confidence", T.DoubleType()), T.StructField("severity", T.StringType()),
    T.StructField("model_version", T.StringType()), T.StructField("pipeline_id", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("rules_applied", T.ArrayType(T.StringType())),
    T.StructField("_corrupt", T.StringType()),
])


def validate_event_contract(df: DataFrame, raw_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """FLT-12: parse alert messages against the event contract (PERMISSIVE,
    corrupt column); valid = parsed, non-empty domain, score in [0, 1],
    severity a known level (or absent).  Returns (valid, quarantine)."""
    p = df.select(F.col(raw_col).alias("_raw"), F.from_json(F.col(raw_col), EVENT_CONTRACT,
                                                             {"mode": "PERMISSIVE",
                                                              "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    ok = (F.col("e").isNotNull() & F.col("e._corrupt").isNull()
          & (F.coalesce(F.length(F.trim("e.domain")), F.lit(0)) > 0)
          & (F.col("e.score").isNull() | F.col("e.score").between(0.0, 1.0))
          & (F.col("e.severity").isNull() | F.col("e.severity").isin(*SEVERITIES)))
    tagged = p.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    valid = tagged.where("_ok").select("e.*").drop("_corrupt")
    quarantine = tagged.where(~F.col("_ok")).select(F.col("_raw").alias(raw_col))
    return valid, quarantine


def extract_features(df: DataFrame, extractors=("lexical", "entropy"), col: str = "domain") -> DataFrame:
    """SCA-8: selected extractor groups merged into one `features` map.  The labels of a
    domain are split once, in a projection of their own, not once for each feature."""
    labels = dict(zip(("_sub", "_sld", "_tld"), split_parts(F.col("_labels"))))
    out = df.withColumn("_labels", F.split(F.col(col), r"\.")).withColumns(labels)
    return out.withColumn("features", feature_map(F.col(col), tuple(extractors), tuple(F.col(c) for c in labels))).drop("_labels", *labels)


def default_missing(features: str, key: str, default: float = 0.0) -> Column:
    """FLT-15: an absent feature counts as `default`."""
    return F.coalesce(F.element_at(F.col(features), F.lit(key)), F.lit(default))


def json_detail(**fields: Column) -> Column:
    """SCA-19: build a JSON detail column from named Columns."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def dedupe_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    """SET-5: one row per event id."""
    return df.dropDuplicates([key])


def merge_scored(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """SET-3: cached results followed by newly scored ones."""
    return cached.withColumn("cached", F.lit(True)).unionByName(
        fresh.withColumn("cached", F.lit(False)), allowMissingColumns=True)


def score_distinct(df: DataFrame, scorer, cache: DataFrame | None = None, now=None,
                   ttl_seconds: int = CACHE_TTL_SECONDS, col: str = "domain") -> DataFrame:
    """JOI-15: score every distinct domain once; reuse cached scores younger
    than the TTL (cache rows: cache_key, score, cached_at); join back.
    `scorer` maps a DataFrame of distinct domains to (domain, score)."""
    keys = df.select(col).distinct().withColumn("cache_key", cache_key(F.col(col)))
    if cache is not None:
        ts_now = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
        fresh_cache = cache.where(F.col("cached_at") > ts_now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
        fresh_cache = fresh_cache.groupBy("cache_key").agg(F.max_by("score", "cached_at").alias("score"))
        hit = keys.join(fresh_cache, "cache_key")
        miss = keys.join(fresh_cache, "cache_key", "left_anti")
    else:
        hit = None
        miss = keys
    scored = scorer(miss.select(col)).select(col, "score").withColumn("cache_key", cache_key(F.col(col)))
    allk = merge_scored(hit.select(col, "cache_key", "score"), scored) if hit is not None else \
        scored.withColumn("cached", F.lit(False))
    return df.join(allk.select(col, "score", "cached"), col, "left")


def node_error_topn(df: DataFrame, n: int = 10) -> DataFrame:
    """AGG-13: recorded step failures per (pipeline, node, error type), top n.
    `errors` is array<struct<node:string,error_type:string,message:string>>."""
    e = df.select("pipeline_id", F.explode("errors").alias("e"))
    g = e.groupBy("pipeline_id", F.col("e.node").alias("node"), F.col("e.error_type").alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"))
    return top_k(g, [F.desc("count"), F.asc("pipeline_id"), F.asc("node"), F.asc("error_type")], n)
