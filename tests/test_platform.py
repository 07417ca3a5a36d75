"""SQL guard, dataflow spec, parsing, contract validation, sinks, streams and
the driver contract."""

import json
import os

import pytest
from pyspark.sql import functions as F

from dnsglass.operators import ingest as IN
from dnsglass.plans import sqlapi
from dnsglass.plans.spec import pipeline_spec, row_step


def test_sql_guard(spark):
    assert sqlapi.validate_sql("SELECT * FROM dga_events") is None
    for bad in ["DROP TABLE dga_events", "DELETE FROM dga_events",
                "INSERT INTO dga_events VALUES ('a')", "SELECT * FROM secret_table",
                "SELECT 1 FROM dga_events; SELECT 2 FROM dga_events"]:
        assert isinstance(sqlapi.validate_sql(bad), str)
    assert sqlapi.validate_sql("/* hi */ SELECT count(*) FROM dga_events -- x") is None
    assert sqlapi.validate_sql("WITH a AS (SELECT * FROM dga_events) SELECT * FROM a JOIN feedback USING (event_id);") is None
    assert sqlapi.validate_sql("SELECT * FROM dga_events WHERE event_id IN (SELECT event_id FROM feedback)") is None
    for bad in ["SELECT 'dga_events' AS feedback FROM parquet.`/etc`", "SELECT * FROM dga_events, other",
                "SELECT * FROM dga_events WHERE event_id IN (SELECT event_id FROM parquet.`/x`)",
                "WITH a AS (SELECT * FROM hidden) SELECT * FROM a, dga_events", "SHOW TABLES", "SELECT 1", "SELECT FROM WHERE", ""]:
        assert isinstance(sqlapi.validate_sql(bad), str), bad
    assert set(sqlapi.FORBIDDEN_KEYWORDS) == {"DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE",
                                              "GRANT", "REVOKE", "EXEC", "EXECUTE", "INTO OUTFILE", "LOAD DATA"}


@pytest.mark.parametrize("bad", [
    "SELECT 'CTE [secret]' c, s.* FROM dga_events d, secret s",
    "SELECT * FROM (WITH secret AS (SELECT 1 x) SELECT * FROM secret) a, dga_events, secret",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret, dga_events",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a, dga_events",
    "SELECT (SELECT max(x) FROM secret) FROM dga_events",
    "SELECT * FROM dga_events WHERE EXISTS (SELECT 1 FROM secret WHERE secret.x = dga_events.score)",
    "SELECT * FROM dga_events UNION ALL SELECT * FROM secret",
    "SELECT * FROM dga_events, LATERAL (SELECT * FROM secret)",
    "SELECT * FROM dga_events, parquet.`/etc`",
    "SELECT * FROM default.dga_events",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM dga_events",
    "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM dga_events",
    "SELECT TRANSFORM(score) USING 'cat' FROM dga_events",
    "SELECT * FROM IDENTIFIER('sec' || 'ret'), dga_events",
    "SELECT * FROM dga_events, some_reader('/x')",
])
def test_sql_guard_reads_scopes(spark, bad):
    assert isinstance(sqlapi.validate_sql(bad), str)


@pytest.mark.parametrize("good", [
    "WITH secret AS (SELECT 1 x) SELECT * FROM secret, dga_events",
    "WITH a AS (SELECT * FROM dga_events), b AS (SELECT * FROM a) SELECT * FROM b WHERE score > (SELECT avg(score) FROM a)",
    "SELECT * FROM (WITH a AS (SELECT * FROM feedback) SELECT * FROM a) x JOIN dga_events USING (event_id)",
    "SELECT domain, explode(split(domain, 'o')) AS part FROM dga_events",
    "SELECT * FROM DGA_EVENTS LATERAL VIEW explode(array(1, 2)) t AS n",
    "SELECT id, count(*) OVER (PARTITION BY severity) FROM dga_events, range(3)",
])
def test_sql_guard_lets_queries_pass(spark, good):
    assert sqlapi.validate_sql(good) is None


def test_ad_hoc_sql_runs(spark, sf001):
    sqlapi.register_event_views(spark, sf001)
    df = sqlapi.ad_hoc_sql(spark, "SELECT severity, count(*) AS n FROM dga_events GROUP BY severity")
    assert df.count() >= 1
    with pytest.raises(sqlapi.SQLRejected):
        sqlapi.ad_hoc_sql(spark, "DROP TABLE dga_events")


def test_parse_dns_branches(spark):
    raw = spark.createDataFrame([('{"query_name": "evil.com", "src_ip": "1.2.3.4"}',), ("evil.com A",),
                                 ("   ",)], "raw string")
    out = IN.parse_dns(raw).collect()
    assert (out[0]["domain"], out[0]["src_ip"], out[0]["query_type"]) == ("evil.com", "1.2.3.4", "")  # Q6
    assert (out[1]["domain"], out[1]["query_type"], out[1]["src_ip"]) == ("evil.com", "A", "")
    only = IN.parse_dns(raw, ["query_name"]).collect()
    assert only[0]["query_type"] == "A"


def test_contract_quarantine(spark):
    msgs = [json.dumps({"event_id": "1", "domain": "a.com", "score": 0.5, "severity": "HIGH"}),
            json.dumps({"event_id": "2", "domain": "", "score": 0.5}), "{not json",
            json.dumps({"event_id": "3", "domain": "b.com", "score": 3.0}),
            json.dumps({"event_id": "4", "domain": "c.com", "severity": "SEVERE"})]
    df = spark.createDataFrame([(m,) for m in msgs], "value string")
    valid, quarantine = IN.validate_event_contract(df)
    assert [r["event_id"] for r in valid.collect()] == ["1"]
    assert quarantine.count() == 4


def test_spec_compiles_and_isolates_errors(spark):
    spec = {"name": "p", "nodes": [
        {"id": "parse", "type": "dns_parser", "config": {"fields": ["query_name", "query_type"]}},
        {"id": "x", "type": "unknown_kind", "config": {}},
        {"id": "thr", "type": "severity_tag", "config": {"critical": 0.9}},
        {"id": "out", "type": "multi_sink", "config": {"targets": [{"type": "es_sink", "condition": "always"},
                                                                  {"type": "kafka_sink", "condition": "is_dga"}]}}]}
    p = pipeline_spec(spec)
    assert p.skipped == ["x"] and [s["type"] for s in p.sinks] == ["es_sink", "kafka_sink"]
    df = spark.createDataFrame([("a.com A", 0.95), ("b.com MX", 0.1)], "raw string, score double")
    out = p.transform(df).collect()
    assert [r["severity"] for r in out] == ["CRITICAL", "LOW"]
    step = row_step(lambda d: str(int(d.split(".")[0], 16)), "domain", "v", "hex")
    res = step(spark.createDataFrame([("ff.com",), ("zz.com",)], "domain string")).collect()
    assert res[0]["v"] == "255" and res[0]["errors"] == []
    assert res[1]["v"] is None and res[1]["errors"][0]["node"] == "hex"
    with pytest.raises(ValueError):
        pipeline_spec({"nodes": [{"id": "t", "type": "threshold", "config": {"nope": 1}}]})


SPECS = {
    "dga-realtime-v1": """
pipeline: {name: dga-realtime-v1, mode: stream, version: "1.0.0"}
nodes:
  - {id: ingest, type: kafka_consumer, config: {topic: dns-query-logs, group_id: g, auto_offset_reset: latest}}
  - {id: parse, type: dns_parser, config: {fields: [query_name, query_type, src_ip, timestamp]}}
  - {id: feature, type: feature_extractor, config: {extractors: [lexical, entropy]}}
  - {id: infer, type: scoring_service, config: {endpoint: "http://s:8001", protocol: http, timeout_ms: 3000}}
  - {id: whitelist, type: whitelist, config: {source: static, static: [google.com]}}
  - {id: threshold, type: threshold, config: {default: 0.7, tenants: {finance: 0.5}}}
  - id: sink
    type: multi_sink
    config:
      targets:
        - {type: kafka, topic: dga-alerts, condition: "score >= threshold"}
        - {type: es, index: "dga-events-{date}", condition: always}
        - {type: starrocks, table: dga_events, condition: always}
checkpoint: {backend: redis, key_prefix: "ckpt:x", commit_interval: 5s}
""",
    "dga-batch-v1": """
pipeline: {name: dga-batch-v1, mode: batch, version: "1.0.0"}
nodes:
  - {id: ingest, type: file_reader, config: {path: PATH}}
  - {id: parse, type: dns_parser, config: {fields: [query_name, query_type, src_ip, timestamp]}}
  - {id: feature, type: feature_extractor, config: {extractors: [lexical, entropy]}}
  - {id: infer, type: scoring_service, config: {endpoint: "http://s:8001", protocol: http, timeout_ms: 1000}}
  - {id: threshold, type: threshold, config: {default: 0.7}}
  - {id: sink, type: multi_sink, config: {targets: [{type: es, index: "dga-events-{date}", condition: always}, {type: starrocks, table: dga_events, condition: always}]}}
""",
    "c2-realtime-v1": """
pipeline: {name: c2-realtime-v1, mode: stream, version: "1.0.0"}
nodes:
  - {id: ingest, type: kafka_consumer, config: {topic: dns-query-logs}}
  - {id: parse, type: dns_parser, config: {fields: [query_name, query_type, src_ip, timestamp]}}
  - {id: feature, type: feature_extractor, config: {extractors: [entropy, lexical, ngram], window_size: 120s}}
  - {id: infer, type: scoring_service, config: {endpoint: "s:50051", protocol: grpc, timeout_ms: 100}}
  - {id: postfilter, type: rule_chain, config: {rules: [{whitelist: {source: redis}}, {threshold: {default: 0.6}}]}}
  - {id: sink, type: multi_sink, config: {targets: [{type: kafka, topic: c2-alerts, condition: "score >= threshold"}, {type: elasticsearch, index: "c2-events-{date}", condition: always}]}}
""",
    "routed": """
pipeline: {name: routed, mode: batch}
nodes:
  - {id: parse, type: dns_parser}
  - {id: infer, type: scoring_service}
  - {id: archive_kafka, type: kafka_sink, config: {topic: low}}
conditional_edges:
  - {from: infer, condition: score_threshold, threshold: 0.7, branches: {high: alert_es, low: archive_kafka}}
""",
}


def test_specs_compile_whole_and_write(spark, tmpdir_path):
    from dnsglass.sources.store import read_event_store
    os.makedirs(f"{tmpdir_path}/logs")
    lines = [json.dumps({"query_name": f"h{i}.com", "query_type": "A", "src_ip": f"1.2.3.{i}", "timestamp": "2024-03-01T10:00:00Z"}) for i in range(10)] + ["google.com A 9.9.9.9", "  "]
    with open(f"{tmpdir_path}/logs/a.log", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")

    def scorer(df):  # h0 .. h9 -> 0.0 .. 0.9, others 0.95
        n = F.try_to_number(F.regexp_extract("domain", "^h([0-9])", 1), F.lit("9")).cast("double")
        return df.withColumn("score", F.coalesce(n / 10, F.lit(0.95)))
    lists = spark.createDataFrame([("whitelist:auto", "google.com"), ("whitelist", "google.com")], "list_name string, entry string")
    for name, text in SPECS.items():
        with pytest.raises(ValueError, match="scor"):
            pipeline_spec(text)
        p = pipeline_spec(text.replace("PATH", f"{tmpdir_path}/logs"), {"scorer": scorer, "lists": lists})
        assert (p.name, p.skipped) == (name, []) and p.mode == ("stream" if "realtime" in name else "batch")
        out = f"{tmpdir_path}/out-{name}"
        source = spark.createDataFrame([(x.strip(),) for x in lines if x.strip()], "raw string")
        if name == "dga-batch-v1":
            report = p.run(spark, out)
        else:
            report = p.write(source, out, "b0")
            assert p.write(source, out, "b0").count() == len(p.sinks)      # the same batch again
        rows = {r["sink"]: (r["ok"], r["rows"], r["error"]) for r in report.collect()}
        if name == "dga-realtime-v1":   # google.com is let through with score 0; h7, h8, h9 are alerts
            assert rows == {"sink_kafka": (True, 3, None), "sink_es": (True, 11, None), "sink_starrocks": (True, 11, None)}
            assert {json.loads(r["value"])["domain"] for r in spark.read.json(f"{out}/kafka/dga-alerts").collect()} == {"h7.com", "h8.com", "h9.com"}
            ev = {r["domain"]: r for r in read_event_store(spark, f"{out}/es/dga-events").collect()}
            assert len(ev) == 11 and ev["google.com"]["score"] == 0.0 and ev["h8.com"]["is_dga"] and str(ev["h8.com"]["event_date"]) == "2024-03-01"
            assert len(ev["h8.com"]["features"]) >= 26 and ev["h8.com"]["tenant_id"] == "default" and ev["h8.com"]["severity"] == "MEDIUM"
            assert spark.read.parquet(f"{out}/starrocks/dga_events").count() == 11
        elif name == "dga-batch-v1":
            assert rows == {"sink_es": (True, 11, None), "sink_starrocks": (True, 11, None)}
            assert read_event_store(spark, f"{out}/es/dga-events").where("is_dga").count() == 4
        elif name == "c2-realtime-v1":
            assert rows == {"sink_kafka": (True, 4, None), "sink_elasticsearch": (True, 11, None)}
        else:
            assert rows == {"archive_kafka": (True, 7, None), "alert_es": (True, 4, None)}
    stream = pipeline_spec(SPECS["dga-realtime-v1"], {"scorer": scorer})
    from dnsglass.sources.readers import read_dns_stream
    for _ in range(2):  # the second run finds nothing new
        stream.start(spark, f"{tmpdir_path}/st", f"{tmpdir_path}/st_ck", source=read_dns_stream(spark, "text", f"{tmpdir_path}/logs")).awaitTermination()
    assert read_event_store(spark, f"{tmpdir_path}/st/es/dga-events").count() == 11


def test_spec_errors(spark):
    with pytest.raises(ValueError, match="circle"):
        pipeline_spec({"nodes": [{"id": "a", "type": "dns_parser"}, {"id": "b", "type": "severity_tag"}],
                       "conditional_edges": [{"from": "b", "branches": {"high": "a"}}]})
    p = pipeline_spec({"nodes": [{"id": "a", "type": "severity_tag", "config": {"score_field": "nope"}}, {"id": "b", "type": "dns_parser"}]})
    (row,) = p.transform(spark.createDataFrame([("x.com A",)], "raw string")).collect()
    assert row["domain"] == "x.com" and [e["node"] for e in row["errors"]] == ["a"]   # a step that cannot be applied


def test_event_store_upsert_is_idempotent(spark, tmpdir_path):
    from dnsglass.sources import store as ES
    from dnsglass.sources.readers import read_events
    from dnsglass.sources.sinks import write_event_store
    rows = [("1", "2024-01-01 01:00:00", "a.com", 0.1, {"x": 1.0}), ("2", "2024-01-02 01:00:00", "b.com", 0.2, None), ("2", "2024-01-02 01:00:00", "b.com", 0.2, {"y": 2.0})]
    df = spark.createDataFrame(rows, "event_id string, ts string, domain string, score double, features map<string,double>").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    path = os.path.join(tmpdir_path, "store")

    def now(**kw):
        return {r["event_id"]: (r["score"], str(r["event_date"])) for r in ES.read_event_store(spark, path, **kw).collect()}
    assert write_event_store(df, path, token="b1") == 1
    assert write_event_store(df.withColumn("score", F.lit(0.5)), path, token="b1") == 1     # retried: nothing changes
    moved = df.where("event_id = '1'").withColumn("score", F.lit(0.9)).withColumn("ts", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    assert write_event_store(moved, path) == 2
    with pytest.raises(ValueError):  # a bad batch is refused and what is stored stays
        write_event_store(df.withColumn("score", F.lit("high")), path)
    with pytest.raises(ValueError):
        write_event_store(df, path, date_pattern="monthly")
    want = {"1": (0.9, "2024-01-03"), "2": (0.2, "2024-01-02")}
    assert now() == want and now(version=1) == {"1": (0.1, "2024-01-01"), "2": (0.2, "2024-01-02")}
    # the event that moved to another day is not found on its old one
    assert [r["event_id"] for r in read_events(spark, path, "2024-01-01", "2024-01-02 23:59:59").collect()] == ["2"]
    plan = read_events(spark, path, "2024-01-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan.replace("event_date#", "event_date")

    def fails(batch):
        raise RuntimeError("lost")
    spark.udf.register("fails", fails)
    with pytest.raises(Exception):  # a write that dies half-way leaves the version readable, the next one succeeds
        write_event_store(df.withColumn("domain", F.expr("fails(domain)")), path)
    assert now() == want
    assert ES.compact_event_store(spark, path) == 3 and now() == want and ES.compact_event_store(spark, path) == 3
    assert ES.vacuum_event_store(spark, path, keep=1) == [1, 2] and now() == want
    assert write_event_store(df.where("event_id = '2'").withColumn("score", F.lit(0.3)), path) == 4
    assert now() == {"1": (0.9, "2024-01-03"), "2": (0.3, "2024-01-02")}


def test_stream_dedupe_and_restart(spark, tmpdir_path):
    from dnsglass.streaming import stream as ST
    src_dir = os.path.join(tmpdir_path, "in")
    out_dir = os.path.join(tmpdir_path, "out")
    ck = os.path.join(tmpdir_path, "ck")
    rows = [("1", "2024-01-01 00:00:00", "a.com"), ("1", "2024-01-01 00:01:00", "a.com"),
            ("2", "2024-01-01 00:02:00", "b.com")]
    spark.createDataFrame(rows, "event_id string, ts string, domain string").write.json(src_dir)
    schema = "event_id string, ts timestamp, domain string"

    def run():
        src = spark.readStream.schema(schema).json(src_dir)
        q = ST.run_stream(src, lambda d: ST.dedupe_stream(d, "event_id", "24 hours"),
                          lambda b, e: b.write.mode("append").parquet(out_dir), ck)
        q.awaitTermination()
    run()
    assert sorted(r["event_id"] for r in spark.read.parquet(out_dir).collect()) == ["1", "2"]
    run()  # restart from the checkpoint: nothing is reprocessed
    assert spark.read.parquet(out_dir).count() == 2


def test_entry_contract(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() > 0
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 170 and len(o) >= 160
