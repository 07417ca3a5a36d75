"""Driver test tables -> the domain model (see FIXTURES.md §B).

These functions only give rows in the schemas the operators expect; they do
none of an operator's work.  Every view is a lazy DataFrame over the parquet
tables, so its size grows with the tables and Catalyst prunes its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import AS_OF, severity_scale


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def wide(df: DataFrame) -> DataFrame:
    """A test table dealt over the cores: its file holds one row group, so the scan is
    a single task.  A table of many files needs none of this."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events fact table."""
    return wide(table(spark, sf_dir, "events"))


def host_of(url) -> "F.Column":
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def round4(x):
    """Half-up rounding to 4 decimals as plain IEEE arithmetic, so that both
    engines produce bit-identical fixture values."""
    return F.floor(x * 10000 + 0.5) / 10000


def _pick(idx, values):
    """values[idx] for a small fixed list (idx is an integer Column)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(None).cast("string") if v is None else F.lit(v)
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def _dns_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_table(spark, sf_dir).withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    # all pages are in use; a fifth of the events goes to two hot ones
    e = e.withColumn("page", F.when(F.col("k") % 5 == 0, F.col("k") % 10).otherwise(F.col("event_id") % p.count()))
    j = e.join(p, p.page_id == e.page)
    u = F.col("user_id")
    score = round4(F.col("value") / (F.col("value") + 10))
    k4 = F.col("k") % 4
    return j.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trace_id"),
        F.col("ts"),
        host_of(F.col("url")).alias("domain"),
        F.concat_ws(".", F.lit("10"), F.expr("user_id div 65536").cast("string"),
                    (F.expr("user_id div 256") % 256).cast("string"),
                    (u % 256).cast("string")).alias("src_ip"),
        (F.lit(167772160) + u).alias("ip_long"),
        _pick(k4, ["A", "AAAA", "MX", "TXT"]).alias("query_type"),
        score.alias("score"),
        F.col("event_type"),
        F.col("value"),
        F.col("user_id"),
        F.col("k"),
        F.col("page_id"),
        F.concat(F.lit("v1."), (F.col("event_id") % 2).cast("string")).alias("model_version"),
        _pick(k4, ["gateway", "dga-realtime-v1", "dns-tunnel-v1", None]).alias("pipeline_id"),
        F.when(k4 == 0, F.col("event_id") % 5 == 0).alias("acknowledged"),
        _pick(u % 3, ["finance", "dev", "default"]).alias("tenant_id"),
    )


def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central stored-event view `dns_events` (FIXTURES.md B.1)."""
    b = _dns_base(spark, sf_dir)
    is_dga = F.col("score") >= 0.7
    return b.select(
        "event_id", "trace_id", "ts", "domain", "src_ip", "ip_long", "query_type", "score",
        is_dga.alias("is_dga"),
        F.when(is_dga, F.col("event_type")).alias("family"),
        F.when(is_dga, round4(F.col("score") * 0.9)).alias("family_confidence"),
        "model_version", "pipeline_id", "tenant_id",
        severity_scale("A", F.col("score"), 0.7).alias("severity"),
        "acknowledged",
        (F.col("event_type") == "error").alias("is_nx"),
        F.col("value").cast("int").alias("response_size"),
        F.to_date("ts").alias("event_date"),
    )


def feedback_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _dns_base(spark, sf_dir)
    m = F.col("page_id") % 3
    true_label = (F.when(m == 0, "benign").when(m == 1, "dga")
                  .when(F.col("event_type") == "error", "benign").otherwise("dga"))
    return b.select(
        "event_id", "domain", true_label.alias("true_label"),
        F.when(F.col("score") >= 0.7, "dga").otherwise("benign").alias("predicted_label"),
        "score", F.col("event_type").alias("family"),
        F.concat(F.lit("analyst-"), (F.col("user_id") % 3).cast("string")).alias("annotator"),
        F.col("ts").alias("created_at"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("entry"))
    return (p.where(F.col("page_id") % 7 <= 1)
            .select(F.when(F.col("page_id") % 7 == 0, "whitelist:auto")
                    .otherwise("blacklist:auto").alias("list_name"),
                    "entry", F.lit("feedback").alias("source")))


def domain_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where(F.col("page_id") % 5 == 0)
    return p.select(host_of(F.col("url")).alias("entry"),
                    F.when(F.col("page_id") % 10 == 0, "feedA").otherwise("feedB").alias("source"),
                    F.concat(F.lit("tag"), (F.col("page_id") % 3).cast("string")).alias("tag"))


def ip_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dns_base(spark, sf_dir).where(F.col("user_id") % 10 == 0)
    return d.select(F.col("src_ip").alias("entry"),
                    F.when(F.col("user_id") % 20 == 0, "feedA").otherwise("feedB").alias("source"),
                    F.lit("scanner").alias("tag")).distinct()


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    start = F.lit(167772160).cast("long") + F.col("n_nationkey") * 60
    return n.select(start.alias("start_ip"), (start + 59).alias("end_ip"),
                    F.col("n_name").alias("country"),
                    F.concat(F.lit("city-"), F.col("n_nationkey").cast("string")).alias("city"),
                    F.col("n_regionkey").alias("asn"))


def intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where(F.col("page_id") % 2 == 0)
    p = p.select(host_of(F.col("url")).alias("domain"), "page_id")
    first = p.groupBy("domain").agg(F.min("page_id").alias("page_id"))
    return first.select("domain",
                        ((F.col("page_id") % 100) / 100.0).alias("reputation"),
                        F.concat(F.lit("fam"), (F.col("page_id") % 5).cast("string")).alias("malware_family"))


def operations_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    op = (F.when(F.col("event_type") == "error", "drift_alert")
          .when(F.col("event_type") == "purchase", "threshold_recommendation").otherwise("save"))
    detail = F.to_json(F.struct(
        F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("feature"),
        F.round(F.col("value") / 500, 4).alias("psi")))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("p"), (F.col("k") % 3).cast("string")).alias("pipeline_id"),
        op.alias("operation"),
        F.concat(F.lit("user"), (F.col("user_id") % 4).cast("string")).alias("operator"),
        _pick(F.col("k") % 3, ["pending", "acknowledged", "dismissed"]).alias("status"),
        detail.alias("detail"),
        F.col("ts").alias("created_at"))


def pipelines_v(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("dga-realtime-v1", "DGA realtime", "running", "realtime"),
         ("dns-tunnel-v1", "DNS tunnel", "stopped", "realtime"),
         ("c2-realtime-v1", "C2 realtime", "running", "realtime")],
        "id string, name string, status string, mode string")


def model_versions_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of 50 models from `part`; the three first of each are in production."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("id"), (F.col("p_partkey") % 50).alias("m"),
        F.expr("p_partkey div 50").alias("v"), F.col("p_size").cast("int").alias("s"))
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(v % 28 as int))")

    def metric(name, base):
        return F.concat(F.lit(f'"{name}": 0.'), (F.col("s") + base).cast("string"))

    return p.select(
        "id", F.when(F.col("m") == 0, "binary").when(F.col("m") == 1, "family")
        .otherwise(F.concat(F.lit("m"), F.col("m").cast("string"))).alias("model_id"),
        F.concat(F.lit("v1."), F.col("v").cast("string")).alias("version"),
        F.when(F.col("v") < 3, "production").when(F.col("s") % 2 == 0, "archived").otherwise("staging").alias("status"),
        ((F.col("s") % 10 + 1).cast("double") / 10).alias("ab_weight"),
        F.concat(F.lit("{"), F.concat_ws(", ", metric("accuracy", 900), metric("f1", 850), metric("precision", 860),
                                         metric("recall", 840)), F.lit("}")).alias("metrics"),
        created.alias("created_at"),
        F.when(F.col("s") % 3 != 0, created + F.expr("interval 1 day")).alias("deployed_at"))


def agent_runs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("role").alias("agent"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"),
        F.length("text").alias("duration_ms"),
        F.when(F.col("turn") % 7 == 6, "error").otherwise("success").alias("status"),
        (F.lit(AS_OF).cast("timestamp_ntz")
         - F.make_dt_interval(secs=(F.col("conv_id") * 100 + F.col("turn")).cast("decimal(18,6)"))
         ).alias("timestamp"))


def drift_samples(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    d = dns_events(spark, sf_dir)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    d = d.where(F.col("ts") < cut) if side == "baseline" else d.where(F.col("ts") >= cut)
    return d.select("ts", "score", F.length("domain").cast("double").alias("domain_len"))


def labelled_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = wide(table(spark, sf_dir, "part"))
    tld = _pick(F.col("p_partkey") % 3, [".com", ".net", ".example.org"])
    dom = F.concat(F.lower(F.regexp_replace("p_name", " ", "-")), F.lit("-"),
                   F.expr("substr(md5(cast(p_partkey as string)), 1, p_size % 12)"), tld)
    target = (F.col("p_size") % 12 >= 6)
    return p.select(dom.alias("domain"), target.cast("int").alias("target"),
                    F.when(target, F.col("p_type")).otherwise("alexa").alias("family"))


def pred_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"),
        ((F.col("n_chars") % 1000) / 1000.0).alias("prob"))


def requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request_id"))
