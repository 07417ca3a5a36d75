"""Config-driven dataflow (UDF-1, UDF-2, SNK-5): a pipeline spec (dict or YAML text)
becomes a graph of DataFrame steps with sources and sinks.

Shape: a header (`pipeline: {name, mode, version}`, or these keys at the top), `nodes`
[{id, type, config}], which follow one another, `conditional_edges`
[{from, condition: score_threshold, threshold, branches: {high, low}}], which replace the
edge behind a node, and `checkpoint`.  A branch may name a sink that is not among the
nodes.  The graph is compiled once, in topological order; a node with several incoming
edges gets their union, a node behind a condition the rows that meet it, so that all
steps up to a branch are one shared sub-plan.  A batch run persists what the sinks
read and writes them with counts taken by `observe`; a stream run does the same for each
micro-batch.

Unknown node types are skipped with a warning and listed in `Pipeline.skipped`; a node
that scores needs a scorer, its lack is an error.  A step that cannot be applied is
recorded in every row's `errors` and the rows go on.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.domain import EXTRACTORS
from ..operators import ingest as IN
from ..operators import rules as RU
from ..schema import DEFAULT_THRESHOLD
from ..sources import readers as RD
from ..sources import sinks as SK
from ..sources.store import has_batch

log = logging.getLogger(__name__)

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class NodeType:
    name: str
    build: Callable[[dict], Transform]
    keys: set[str] = field(default_factory=set)
    is_sink: bool = False
    is_source: bool = False


REGISTRY: dict[str, NodeType] = {}


def register_node(name: str, keys: set[str] | None = None, is_sink: bool = False):
    """UDF-2: register a user step.  `fn(config) -> (DataFrame -> DataFrame)`."""
    def deco(fn):
        REGISTRY[name] = NodeType(name, fn, set(keys or ()), is_sink)
        return fn
    return deco


def _with_errors(df: DataFrame) -> DataFrame:
    return df if "errors" in df.columns else df.withColumn(
        "errors", F.array().cast("array<struct<node:string,error_type:string,message:string>>"))


def row_step(fn: Callable[[str], str], input_col: str, output_col: str, node: str) -> Transform:
    """Wrap a per-row Python function as an Arrow-batched step whose failures
    are isolated per row: the row continues, the error is appended to the
    `errors` array column (node, error_type, message)."""
    out_t = T.StructType([T.StructField("v", T.StringType()), T.StructField("err", T.StringType()),
                          T.StructField("msg", T.StringType())])

    @F.pandas_udf(out_t)
    def apply(s: pd.Series) -> pd.DataFrame:
        vals, errs, msgs = [], [], []
        for x in s:
            try:
                vals.append(fn(x))
                errs.append(None)
                msgs.append(None)
            except Exception as e:  # noqa: BLE001
                vals.append(None)
                errs.append(type(e).__name__)
                msgs.append(str(e))
        return pd.DataFrame({"v": vals, "err": errs, "msg": msgs})

    def run(df: DataFrame) -> DataFrame:
        df = _with_errors(df)
        r = df.withColumn("_r", apply(F.col(input_col)))
        err = F.struct(F.lit(node).alias("node"), F.col("_r.err").alias("error_type"), F.col("_r.msg").alias("message"))
        return (r.withColumn(output_col, F.col("_r.v"))
                .withColumn("errors", F.when(F.col("_r.err").isNotNull(), F.array_append("errors", err))
                            .otherwise(F.col("errors"))).drop("_r"))
    return run


# --- built-in node types ----------------------------------------------------------------------------

def _features(c: dict) -> Transform:
    known = tuple(e for e in c.get("extractors", ("lexical", "entropy")) if e in EXTRACTORS)
    return lambda df: IN.extract_features(df, known)


def _scoring(c: dict) -> Transform:
    """The scorer of the context (DataFrame -> DataFrame with `score`, and what else of
    is_dga, family, family_confidence and model_version it knows); others get the defaults
    of a failed call."""
    if c.get("_scorer") is None:
        raise ValueError("a scoring_service node needs context={'scorer': ...}")

    def run(df: DataFrame) -> DataFrame:
        out = c["_scorer"](df)
        for name, kind in (("family", "string"), ("family_confidence", "double"), ("model_version", "string")):
            if name not in out.columns:
                out = out.withColumn(name, F.lit("" if name == "model_version" else None).cast(kind))
        out = out.withColumn("score", F.coalesce("score", F.lit(0.0)))
        return out if "is_dga" in out.columns else out.withColumn("is_dga", F.lit(False))
    return run


def _rule_chain(c: dict) -> Transform:
    """[{rule: config}, ...] in order, each a registered node type."""
    steps = [_built(name, name, cfg or {}, c) for rule in c.get("rules", []) for name, cfg in rule.items()]
    return lambda df: reduce(lambda d, step: step(d), steps, df)


def _read_files(c: dict) -> Callable[[SparkSession, bool], DataFrame]:
    def run(spark: SparkSession, stream: bool) -> DataFrame:
        if not c.get("path"):
            raise ValueError("a file_reader node needs a path")
        if stream:
            return RD.read_dns_stream(spark, "text", c["path"])
        return RD.read_log_dir(spark, c["path"], c.get("pattern", "*"), c.get("recursive", False))
    return run


def _read_topic(c: dict) -> Callable[[SparkSession, bool], DataFrame]:
    def run(spark: SparkSession, stream: bool) -> DataFrame:
        options = {"subscribe": c.get("topic", "dns-query-logs"), "startingOffsets": c.get("auto_offset_reset", "latest"), **c.get("options", {})}
        if stream:
            return RD.read_dns_stream(spark, "kafka", options=options)
        return spark.read.format("kafka").options(**options | {"startingOffsets": "earliest"}).load().select(F.col("value").cast("string").alias("raw"), "topic")
    return run


REGISTRY["file_reader"] = NodeType("file_reader", _read_files, {"path", "pattern", "recursive", "encoding"}, is_source=True)
REGISTRY["kafka_consumer"] = NodeType("kafka_consumer", _read_topic, {"topic", "group_id", "auto_offset_reset", "options"}, is_source=True)
register_node("dns_parser", {"fields"})(lambda c: lambda df: IN.parse_dns(df, c.get("fields")))
register_node("feature_extractor", {"extractors", "ngram", "window_size"})(_features)
register_node("scoring_service", {"endpoint", "protocol", "timeout_ms"})(_scoring)
register_node("rule_chain", {"rules"})(_rule_chain)
register_node("whitelist", {"source", "static"})(lambda c: lambda df: RU.allowlist(df, c.get("static"), c.get("_lists")))
register_node("blacklist", {"source", "static"})(lambda c: lambda df: RU.denylist(df, c.get("static"), c.get("_lists")))
register_node("threshold", {"default", "tenants", "rules"})(
    lambda c: lambda df: RU.apply_threshold(df, c.get("default", DEFAULT_THRESHOLD), c.get("tenants")))
register_node("threshold_action", {"threshold", "action_below", "min_score", "max_score"})(
    lambda c: lambda df: RU.threshold_action(df, c.get("threshold", 0.7), c.get("action_below", "drop"),
                                             c.get("min_score"), c.get("max_score")))
register_node("severity_tag", {"critical", "high", "medium", "score_field", "output_field"})(
    lambda c: lambda df: RU.severity_tag(df, c.get("critical", 0.95), c.get("high", 0.85), c.get("medium", 0.7),
                                         c.get("score_field", "score"), c.get("output_field", "severity")))
register_node("domain_validate", {"lower"})(lambda c: lambda df: IN.validate_domains(df, lower=c.get("lower", True)))
register_node("list_match", {"list", "mode", "on_match"})(
    lambda c: lambda df: RU.list_match(df, c["list"], c.get("mode", "exact"), c.get("on_match", "tag")))
register_node("intel_enrich", {"intel", "fields", "fail_open"})(
    lambda c: lambda df: RU.intel_enrich(df, c["intel"], tuple(c.get("fields", ("reputation", "malware_family"))),
                                         c.get("fail_open", True)))
register_node("geo_enrich", {"ranges", "ip_field", "high_risk"})(
    lambda c: lambda df: RU.geo_enrich(df, c["ranges"], c.get("ip_field", "ip_long"),
                                       tuple(c.get("high_risk", ("IRAN", "RUSSIA", "CHINA")))))
register_node("score_route", {"threshold", "high", "low"})(
    lambda c: lambda df: RU.score_route(df, c.get("threshold", 0.7), c.get("high", "high"), c.get("low", "low")))
register_node("dedupe", {"key"})(lambda c: lambda df: IN.dedupe_events(df, c.get("key", "event_id")))
_SINK_KEYS = {"condition", "targets", "topic", "index", "table", "path", "date_pattern", "on_error", "key"}
for _sink in ("es_sink", "elasticsearch", "kafka_sink", "starrocks_sink", "multi_sink", "fan_out", "file_sink"):
    register_node(_sink, _SINK_KEYS, is_sink=True)(lambda c: lambda df: df)


def _built(node: str, kind: str, config: dict, context: dict) -> Transform:
    """The step of a node after a check of its config keys."""
    nt = REGISTRY[kind]
    bad = set(config) - nt.keys
    if bad and nt.keys:
        raise ValueError(f"node {node} ({kind}): unknown config keys {sorted(bad)}")
    return nt.build({**config, **{k: v for k, v in context.items() if k.startswith("_")}})


# --- sinks ------------------------------------------------------------------------------------------

#: Names of a sink type in specs -> the writer that it stands for.
SINK_TYPES = {"es": "es_sink", "elasticsearch": "es_sink", "es_sink": "es_sink", "kafka": "kafka_sink", "kafka_sink": "kafka_sink",
              "starrocks": "starrocks_sink", "starrocks_sink": "starrocks_sink", "file": "file_sink", "file_sink": "file_sink"}


def _expand_sinks(node_id: str, kind: str, config: dict) -> list[dict]:
    """The sinks of a node: one, or one for each target, as {id, type, condition, ...}."""
    if kind in ("multi_sink", "fan_out"):
        out = []
        for target in config.get("targets", []):
            t = SINK_TYPES.get(target.get("type", "es"), "es_sink")
            out.append({"on_error": config.get("on_error", "continue"), **target, "id": f"{node_id}_{target.get('type', 'es')}", "type": t})
        return out
    return [{**config, "id": node_id, "type": SINK_TYPES.get(kind, "es_sink")}]


def _inferred(node_id: str) -> str:
    """The sink type of a branch target that is no node: by its name, else the event store."""
    return next((kind for word, kind in (("kafka", "kafka_sink"), ("starrocks", "starrocks_sink")) if word in node_id), "es_sink")


def _condition(sink: dict, columns: list[str]) -> Column:
    """The rows that a sink takes; `score >= threshold` means the row's own threshold if it has one."""
    name = sink.get("condition", "always")
    if name == "score >= threshold" and "threshold" in columns:
        return F.coalesce(F.col("score"), F.lit(0.0)) >= F.col("threshold")
    return RU.sink_condition(name)


def sink_path(sink: dict, out: str) -> str:
    """Where a sink writes below `out`: its path, or its index (without the date, which is
    the table's partition), topic or table by the sink's type."""
    if sink.get("path"):
        return sink["path"]
    name = sink.get("index") or sink.get("topic") or sink.get("table") or sink["id"]
    return f"{out}/{sink['type'].removesuffix('_sink')}/{name.replace('-{date}', '').replace('{date}', '') or sink['id']}"


def sink_writer(sink: dict, out: str, batch: str | None = None) -> Callable[[DataFrame], bool]:
    """The writer of a sink; with a batch's name a repeated write of the batch changes nothing."""
    path = sink_path(sink, out)

    def write(df: DataFrame) -> bool:
        if sink["type"] == "es_sink":
            if batch and has_batch(df.sparkSession, path, batch):
                return False
            SK.write_event_store(df, path, None, sink.get("date_pattern", "daily"), token=batch)
            return True
        if sink["type"] == "kafka_sink":
            rows = SK.alert_messages(df, sink.get("key", "domain"), None)
        else:
            rows = SK.olap_projection(df) if sink["type"] == "starrocks_sink" else df
        to = f"{path}/batch={batch}" if batch else path
        writer = rows.write.mode("overwrite" if batch else "append")
        if sink["type"] == "starrocks_sink":
            writer = writer.partitionBy("event_date")
        (writer.json if sink["type"] == "kafka_sink" else writer.parquet)(to)
        return True
    return write


def _with_missing(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    for name, value in made.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def _initial(df: DataFrame, pipeline_id: str) -> DataFrame:
    """The rows of a source with what every event has from the start; a missing id is the
    hash of the message and where it came from."""
    have = set(df.columns)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("raw", "domain", "topic", "partition", "offset", "file_path") if c in have]
    df = _with_missing(df, {"event_id": F.sha2(F.concat_ws("\x1f", *key), 256).substr(1, 32), "pipeline_id": F.lit(pipeline_id), "tenant_id": F.lit("default")})
    return _with_missing(df, {"trace_id": F.col("event_id").cast("string")})


def _event_columns(df: DataFrame) -> DataFrame:
    """The rows with all columns of a stored event; what no step has set is null or a default."""
    now = F.current_timestamp()
    at = F.coalesce(F.try_to_timestamp(F.col("event_timestamp")), now) if "event_timestamp" in df.columns else now
    return _with_missing(df, {
        "ts": at.cast("timestamp_ntz"), "domain": F.lit(""), "src_ip": F.lit(None).cast("string"), "score": F.lit(0.0), "is_dga": F.lit(False),
        "family": F.lit(None).cast("string"), "family_confidence": F.lit(None).cast("double"), "model_version": F.lit(""), "severity": F.lit(None).cast("string")})


# --- the compiler -----------------------------------------------------------------------------------

@dataclass
class Edge:
    source: str
    target: str
    threshold: float | None = None  # rows with score >= threshold (high) or below it
    high: bool = True


@dataclass
class Pipeline:
    name: str
    mode: str
    version: str
    source: Callable[[SparkSession, bool], DataFrame] | None
    order: list[str]                    # ids of the steps and sinks, topological
    steps: dict[str, Transform]
    edges: list[Edge]
    sinks: list[dict]                   # in order, each with the id of its node in `node`
    skipped: list[str]
    checkpoint: dict

    def frames(self, df: DataFrame) -> dict[str, DataFrame]:
        """What reaches every node behind its step, from the rows of the source."""
        out: dict[str, DataFrame] = {}
        df = _initial(df, self.name)
        for i, node in enumerate(self.order):
            inputs = []
            for e in self.edges:
                if e.target != node or e.source not in out:
                    continue
                rows = out[e.source]
                if e.threshold is not None:
                    above = F.coalesce(F.col("score"), F.lit(0.0)) >= e.threshold
                    rows = rows.where(above if e.high else ~above)
                inputs.append(rows)
            if not inputs:
                if i:
                    continue  # nothing leads here
                inputs = [df]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
            out[node] = self._applied(node, rows)
        return out

    def _applied(self, node: str, rows: DataFrame) -> DataFrame:
        if node not in self.steps:
            return rows
        try:
            return self.steps[node](rows)
        except (AnalysisException, ValueError, KeyError) as e:
            log.warning("step %s failed: %s", node, e)
            error = F.struct(F.lit(node).alias("node"), F.lit(type(e).__name__).alias("error_type"), F.lit(str(e)).alias("message"))
            return _with_errors(rows).withColumn("errors", F.array_append("errors", error))

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows behind the last step, sinks aside."""
        out = self.frames(df)
        last = [n for n in self.order if n in self.steps and n in out]
        return out[last[-1]] if last else _initial(df, self.name)

    def write(self, df: DataFrame, out: str, batch: str | None = None) -> DataFrame:
        """Runs the steps on a batch and writes all sinks below `out`: the report (sink, ok,
        error, rows)."""
        frames = self.frames(df)
        reports = []
        by_input: dict[str, list[dict]] = {}
        for sink in self.sinks:
            if sink["node"] in frames:
                by_input.setdefault(sink["node"], []).append(sink)
        shared = {id(f): f for f in (frames[n] for n in by_input)}
        for f in shared.values():
            f.persist()
        try:
            for node, sinks in by_input.items():
                rows = _event_columns(frames[node])
                targets = [(s["id"], _condition(s, rows.columns), sink_writer(s, out, batch)) for s in sinks]
                reports.append(SK.fan_out(rows, targets, sinks[0].get("on_error", "continue")))
        finally:
            for f in shared.values():
                f.unpersist()
        if not reports:
            return df.sparkSession.createDataFrame([], "sink string, ok boolean, error string, rows long")
        return reduce(DataFrame.union, reports)

    def _read(self, spark: SparkSession, stream: bool) -> DataFrame:
        if self.source is None:
            raise ValueError(f"pipeline {self.name} has no source node; hand its rows to write()")
        return self.source(spark, stream)

    def run(self, spark: SparkSession, out: str) -> DataFrame:
        """Reads the source once and writes all sinks: the report."""
        return self.write(self._read(spark, False), out)

    def start(self, spark: SparkSession, out: str, checkpoint: str, trigger: dict | None = None, source: DataFrame | None = None) -> StreamingQuery:
        """The pipeline as a streaming query; each micro-batch is written like a batch and
        a repeated one changes nothing."""
        rows = source if source is not None else self._read(spark, True)
        writer = rows.writeStream.foreachBatch(lambda b, epoch: self.write(b, out, f"{self.name}-{epoch}"))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pipeline_spec(spec: dict | str, context: dict | None = None) -> Pipeline:
    """Compiles a spec.  `context` holds what a spec cannot: `scorer` (DataFrame ->
    DataFrame) for scoring nodes, `lists` (list_name, entry) for dynamic allow and deny lists."""
    if isinstance(spec, str):
        import yaml
        spec = yaml.safe_load(spec)
    header = spec.get("pipeline") or spec
    given = {f"_{k.lstrip('_')}": v for k, v in (context or {}).items()}
    source, steps, sinks, skipped, ids = None, {}, [], [], []
    for node in spec.get("nodes", []):
        kind, node_id, config = node.get("type"), str(node.get("id", node.get("type"))), dict(node.get("config") or {})
        if kind not in REGISTRY:
            log.warning("unknown node type %s skipped", kind)
            skipped.append(node_id)
            continue
        if node_id in ids:
            raise ValueError(f"two nodes named {node_id}")
        if REGISTRY[kind].is_source:
            if ids or source is not None:
                raise ValueError(f"source node {node_id} must be the only one and come first")
            source = _built(node_id, kind, config, {})
            continue
        built = _built(node_id, kind, config, given)
        ids.append(node_id)
        if REGISTRY[kind].is_sink:
            sinks += [{**s, "node": node_id} for s in _expand_sinks(node_id, kind, config)]
        else:
            steps[node_id] = built
    if not ids:
        raise ValueError(f"pipeline {header.get('name', '')} has no nodes")
    edges = [Edge(a, b) for a, b in zip(ids[:-1], ids[1:])]
    for c in spec.get("conditional_edges") or []:
        start, branches = c["from"], c.get("branches", {})
        if start not in ids:
            raise ValueError(f"conditional edge from {start}, which is no node")
        if c.get("condition", "score_threshold") != "score_threshold":
            log.warning("unknown condition %s: the plain edge stays", c["condition"])
            continue
        plain = next((e.target for e in edges if e.source == start), None)
        edges = [e for e in edges if e.source != start]
        for key, high in (("high", True), ("low", False)):
            target = branches.get(key, plain)
            if target is None:
                continue
            if target not in ids:
                ids.append(target)
                sinks.append({"id": target, "type": _inferred(target), "condition": "always", "node": target})
            edges.append(Edge(start, target, float(c.get("threshold", 0.5)), high))
    return Pipeline(header.get("name", "pipeline"), header.get("mode", "realtime"), str(header.get("version", "1")),
                    source, _topological(ids, edges), steps, edges, sinks, skipped, dict(spec.get("checkpoint") or {}))


def _topological(ids: list[str], edges: list[Edge]) -> list[str]:
    """The ids in an order in which all edges point forward; of several the given one."""
    out: list[str] = []
    while len(out) < len(ids):
        free = [n for n in ids if n not in out and all(e.source in out for e in edges if e.target == n)]
        if not free:
            raise ValueError("the edges form a circle: " + ", ".join(n for n in ids if n not in out))
        out.append(free[0])
    return out
