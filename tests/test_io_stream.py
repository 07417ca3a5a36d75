"""Readers, sinks and the streaming forms, on small files in a scratch folder."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from dnsglass.sources import readers as RD
from dnsglass.sources import sinks as SK
from dnsglass.streaming import stream as ST


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_log_lines_and_dir(spark, tmpdir_path):
    _write(f"{tmpdir_path}/logs/a.json", '{"query_name": "x.com"}\n\n  evil.com A  \n')
    _write(f"{tmpdir_path}/logs/b.json", '{"query_name": "y.com"}\n')
    _write(f"{tmpdir_path}/logs/skip.txt", "z.com A\n")
    lines = RD.read_log_lines(spark, f"{tmpdir_path}/logs/a.json").collect()
    assert [(r["raw"], r["is_json"]) for r in lines] == [('{"query_name": "x.com"}', True), ("evil.com A", False)]
    d = RD.read_log_dir(spark, f"{tmpdir_path}/logs", "*.json")
    assert d.count() == 3
    per = {r["file_path"]: r["lines"] for r in RD.file_counters(d).collect()}
    assert per[None] == 3 and len(per) == 3


def test_labelled_and_docs_and_records(spark, tmpdir_path):
    _write(f"{tmpdir_path}/lab/d.csv", "Domain,Target,Botnet_Family\ngoogle.com,0,alexa\nx1y2.biz,1,conficker\n")
    lab = RD.read_labelled_domains(spark, f"{tmpdir_path}/lab").collect()
    assert [(r["domain"], r["target"], r["family"]) for r in lab] == [("google.com", 0, "alexa"),
                                                                     ("x1y2.biz", 1, "conficker")]
    _write(f"{tmpdir_path}/kb/families/conficker.md", "# Conficker\nline two\n")
    _write(f"{tmpdir_path}/kb/sop/block.md", "block it")
    _write(f"{tmpdir_path}/kb/sop/ignore.txt", "no")
    docs = {r["title"]: r for r in RD.read_knowledge_docs(spark, f"{tmpdir_path}/kb").collect()}
    assert set(docs) == {"conficker", "block"} and docs["conficker"]["category"] == "families"
    assert docs["conficker"]["content"] == "# Conficker\nline two\n"
    _write(f"{tmpdir_path}/rec/r.jsonl", json.dumps({"a": 1}) + "\n" + json.dumps({"a": 2}) + "\n")
    assert RD.read_records(spark, f"{tmpdir_path}/rec", "jsonl", schema="a int").count() == 2


def test_fan_out_and_export(spark, tmpdir_path):
    df = spark.createDataFrame([("1", 0.9, True, "HIGH"), ("2", 0.1, False, "LOW")],
                               "event_id string, score double, is_dga boolean, severity string")
    written = {}

    def ok(name):
        return lambda part: written.__setitem__(name, part.count())

    def fail(part):
        raise RuntimeError("store down")
    rep = {r["sink"]: r for r in SK.fan_out(df, [("es", "always", ok("es")), ("kafka", "is_dga", ok("kafka")),
                                                 ("olap", "is_dga", fail)]).collect()}
    assert written == {"es": 2, "kafka": 1}
    assert rep["olap"]["ok"] is False and "store down" in rep["olap"]["error"] and rep["kafka"]["rows"] == 1
    SK.export_report(df, f"{tmpdir_path}/rep", "csv")
    back = spark.read.option("header", "true").csv(f"{tmpdir_path}/rep")
    assert back.count() == 2 and back.columns == df.columns
    fb = spark.createDataFrame([("e", "a.com", "BENIGN", None, None, None, None, None),
                                ("f", "b.com", "maybe", None, None, None, None, None)],
                               "event_id string, domain string, true_label string, predicted_label string, "
                               "score double, family string, annotator string, created_at timestamp_ntz")
    assert [r["true_label"] for r in SK.append_feedback(fb, f"{tmpdir_path}/fb", f"{tmpdir_path}/no").collect()] == ["benign"]
    assert [(r["event_id"], r["reason"]) for r in spark.read.parquet(f"{tmpdir_path}/no").collect()] == [("f", "unknown label")]


def _stream_dir(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def test_nxdomain_stream_session(spark, tmpdir_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("10.0.0.1", t, True), ("10.0.0.1", t + dt.timedelta(seconds=100), False),
            ("10.0.0.1", t + dt.timedelta(seconds=500), True), ("10.0.0.2", t, False)]
    src = f"{tmpdir_path}/nx"
    _stream_dir(spark, src, rows, "src_ip string, ts timestamp, is_nx boolean")
    s = spark.readStream.schema("src_ip string, ts timestamp, is_nx boolean").parquet(src)
    out_dir = f"{tmpdir_path}/nx_out"
    q = (ST.nxdomain_stream(s, 60, delay="0 seconds").writeStream.outputMode("append")
         .format("parquet").option("path", out_dir).option("checkpointLocation", f"{tmpdir_path}/nx_ck")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    # a later event advances the watermark so the open sessions are emitted
    _stream_dir(spark, src, [("10.0.0.9", t + dt.timedelta(hours=2), False)], "src_ip string, ts timestamp, is_nx boolean")
    q = (ST.nxdomain_stream(spark.readStream.schema("src_ip string, ts timestamp, is_nx boolean").parquet(src), 60,
                            delay="0 seconds").writeStream.outputMode("append").format("parquet")
         .option("path", out_dir).option("checkpointLocation", f"{tmpdir_path}/nx_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["src_ip"], r["total"], r["nx"]) for r in spark.read.parquet(out_dir).collect())
    assert ("10.0.0.1", 2, 1) in got and ("10.0.0.1", 1, 1) in got and ("10.0.0.2", 1, 0) in got


def test_triage_stream_interval_join(spark, tmpdir_path):
    t = dt.datetime(2024, 1, 1, 12)
    ev = [(f"e{i}", "10.0.0.5", t + dt.timedelta(seconds=20 * i), 0.3) for i in range(6)]
    al = [("a1", "10.0.0.5", t + dt.timedelta(seconds=60), 0.4)]
    schema = "event_id string, src_ip string, ts timestamp, score double"
    _stream_dir(spark, f"{tmpdir_path}/ev", ev, schema)
    _stream_dir(spark, f"{tmpdir_path}/al", al, schema)
    events = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/ev")
    alerts = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/al")
    out = ST.triage_stream(alerts, events, 300, "1 minute")
    tr_out = f"{tmpdir_path}/tr_out"
    q = (out.writeStream.outputMode("append").format("parquet").option("path", tr_out)
         .option("checkpointLocation", f"{tmpdir_path}/tr_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    # move the watermark past the alert's interval and flush the aggregate
    _stream_dir(spark, f"{tmpdir_path}/al", [("a2", "10.0.0.6", t + dt.timedelta(hours=3), 0.1)], schema)
    _stream_dir(spark, f"{tmpdir_path}/ev", [("z", "10.0.0.6", t + dt.timedelta(hours=3), 0.1)], schema)
    q = (ST.triage_stream(spark.readStream.schema(schema).parquet(f"{tmpdir_path}/al"),
                          spark.readStream.schema(schema).parquet(f"{tmpdir_path}/ev"), 300, "1 minute")
         .writeStream.outputMode("append").format("parquet").option("path", tr_out)
         .option("checkpointLocation", f"{tmpdir_path}/tr_ck").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(tr_out).collect()
    a1 = [r for r in rows if r["alert_id"] == "a1"]
    assert a1 and a1[0]["correlated_count"] == 6 and a1[0]["triage_severity"] == "CRITICAL"


def _run(df, sink, checkpoint):
    q = df.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_score_cache_stream_ttl(spark, tmpdir_path):
    """Scored once, kept over a restart, scored anew when the time to live is over."""
    import time
    schema = "domain string, ts timestamp, n int"
    t = dt.datetime(2024, 1, 1)
    calls = spark.sparkContext.accumulator(0)

    def scorer(s):
        calls.add(len(s))
        return s.str.len() / 10.0

    def go(rows, ttl, name):
        _stream_dir(spark, f"{tmpdir_path}/sc", rows, schema)
        src = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/sc")
        with ST.stateful_settings(spark):
            _run(ST.score_cache_stream(src, scorer, ttl), lambda b, e: b.write.mode("append").parquet(f"{tmpdir_path}/{name}"), f"{tmpdir_path}/sc_ck")
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/{name}").drop("ts").collect())
    assert go([("a.com", t, 1), ("a.com", t, 2), ("bb.com", t, 3)], 60, "o1") == [("a.com", 1, .5, False), ("a.com", 2, .5, False), ("bb.com", 3, .6, False)]
    assert calls.value == 2
    assert go([("a.com", t, 4), ("c.com", t, 5)], 60, "o2") == [("a.com", 4, .5, True), ("c.com", 5, .5, False)]
    assert calls.value == 3
    assert [r[3] for r in go([("a.com", t, 6)], 60, "o3")] == [True]
    ck = f"{tmpdir_path}/sc_ck2"

    def short(rows, name):
        _stream_dir(spark, f"{tmpdir_path}/sd", rows, schema)
        src = spark.readStream.schema(schema).parquet(f"{tmpdir_path}/sd")
        with ST.stateful_settings(spark):
            _run(ST.score_cache_stream(src, scorer, 1), lambda b, e: b.write.mode("append").parquet(f"{tmpdir_path}/{name}"), ck)
        return [r["cached"] for r in spark.read.parquet(f"{tmpdir_path}/{name}").collect()]
    assert short([("a.com", t, 1)], "s1") == [False]
    time.sleep(1.5)
    assert short([("a.com", t, 2)], "s2") == [False]


def test_late_rows_go_to_quarantine(spark, tmpdir_path):
    """The watermark of earlier batches decides, also after a restart."""
    schema = "event_id string, ts timestamp"
    t = dt.datetime(2024, 1, 1, 12)
    src, main, late, ck = (f"{tmpdir_path}/{x}" for x in ("late_in", "main", "late", "late_ck"))

    def go(rows):
        _stream_dir(spark, src, rows, schema)
        ST.late_data_policy(spark.readStream.schema(schema).parquet(src), main, late, ck, "10 minutes").awaitTermination()
        return [sorted(r["event_id"] for r in spark.read.schema(schema).parquet(p).collect()) for p in (main, late)]
    assert go([("a", t), ("old", t - dt.timedelta(hours=5))]) == [["a", "old"], []]       # no watermark yet
    assert go([("b", t + dt.timedelta(hours=1)), ("c", t - dt.timedelta(minutes=9)), ("d", t - dt.timedelta(minutes=11)), ("n", None)]) == [["a", "b", "c", "n", "old"], ["d"]]
    assert go([("e", t + dt.timedelta(minutes=49)), ("f", t + dt.timedelta(minutes=51))]) == [["a", "b", "c", "f", "n", "old"], ["d", "e"]]


def test_triage_chain_streams_like_the_batch(spark, tmpdir_path):
    """All four outputs of the stream equal the batch chain on the same events."""
    from dnsglass.operators import chain as CH
    from dnsglass.operators import correlate as CO
    from dnsglass.sources.versions import next_version
    t = dt.datetime(2024, 1, 1, 12)
    schema = "event_id string, src_ip string, ts timestamp, score double, domain string, family string"
    ev = [(f"e{i}", f"10.0.0.{i % 3}", t + dt.timedelta(seconds=70 * i), (i % 10) / 10, f"x{i % 5}9k.com", "f" if i % 2 else None) for i in range(40)]
    al = [e for e in ev if e[3] >= 0.4]
    intel = spark.createDataFrame([("domain", "x09k.com", "feed1", "c2"), ("ip", "10.0.0.1", "feed2", "scan"), ("ip", "10.0.0.1", "feed3", "c2")],
                                  "kind string, entry string, source string, tag string")
    next_version(spark, f"{tmpdir_path}/intel", lambda old: intel.limit(0), "empty")
    next_version(spark, f"{tmpdir_path}/intel", lambda old: intel, "feeds")
    far = t + dt.timedelta(days=1)

    def go(alerts, events):
        _stream_dir(spark, f"{tmpdir_path}/tal", alerts, schema)
        _stream_dir(spark, f"{tmpdir_path}/tev", events, schema)
        a, e = (spark.readStream.schema(schema).parquet(f"{tmpdir_path}/{x}") for x in ("tal", "tev"))
        _run(ST.triage_stream(a, e, 300, "1 minute"), ST.triage_sink(f"{tmpdir_path}/chain", f"{tmpdir_path}/intel"), f"{tmpdir_path}/chain_ck")
    go(al, ev)
    go([("z", "9.9.9.9", far, 0.1, "z", None)], [("z", "9.9.9.9", far, 0.1, "z", None)])   # moves the watermark
    all_events = spark.createDataFrame(ev, schema)
    batch = CO.triage(all_events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).filter("score >= 0.4").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, want in CH.alert_chain(batch, intel).items():
        got = spark.read.parquet(f"{tmpdir_path}/chain/{name}").drop("epoch").select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        assert want.count() >= len(al)


def test_versions_grow_over_lost_checkpoints(spark, tmpdir_path):
    """A query that starts over at epoch 0 publishes a newer version, a retried batch none."""
    schema = "domain string, true_label string, family string, created_at timestamp_ntz"
    fb, lists, src = (f"{tmpdir_path}/{x}" for x in ("vfb", "vlists", "vsrc"))

    def feedback(domain):
        spark.createDataFrame([(domain, "benign", "f", dt.datetime(2024, 1, 30))] * 6, schema).write.mode("append").parquet(fb)

    def go(ck):
        _stream_dir(spark, src, [("x", dt.datetime(2024, 1, 1))], "domain string, ts timestamp")
        _run(spark.readStream.schema("domain string, ts timestamp").parquet(src), ST.feedback_refresh_batch(lists, fb, f"{tmpdir_path}/vaudit", "2024-01-31 00:00:00"), f"{tmpdir_path}/{ck}")
        return sorted(r["entry"] for r in ST.current_lists(spark, lists).collect())
    assert ST.current_lists(spark, lists) is None
    feedback("one.com")
    assert go("ck1") == ["one.com"]
    feedback("two.com")
    assert go("ck2") == ["one.com", "two.com"]      # epoch 0 again
    feedback("three.com")
    assert go("ck2") == ["one.com", "three.com", "two.com"]
    audit = spark.read.parquet(f"{tmpdir_path}/vaudit")
    assert sorted((r["version"], r["n"]) for r in audit.groupBy("version").agg(F.count("*").alias("n")).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_drift_and_feedback_batches(spark, tmpdir_path):
    import random

    from dnsglass.sources.versions import current_version
    rnd = random.Random(2)
    base = spark.createDataFrame([(rnd.uniform(0, .3), 10.0) for _ in range(200)], "score double, domain_len double")
    batch = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), rnd.uniform(.7, 1), 50.0, str(i))
                                   for i in range(300)], "ts timestamp, score double, domain_len double, event_id string")
    ops = f"{tmpdir_path}/ops"
    ST.drift_monitor_batch(1000, base, ops_path=ops)(batch, 0)
    assert {r["feature"] for r in spark.read.parquet(ops).collect()} == {"score", "domain_len"}
    ST.drift_monitor_batch(1000, base, ops_path=ops)(batch, 1)   # cooldown: nothing new
    ST.drift_monitor_batch(1000, base, ops_path=ops)(batch, 0)   # a retried epoch writes its rows once
    assert spark.read.parquet(ops).count() == 2
    # batches under the least sample count add up over the window, which keeps the newest rows only
    ops2, win = f"{tmpdir_path}/ops2", f"{tmpdir_path}/win"
    body = ST.drift_monitor_batch(250, base, ops_path=ops2, window_path=win)
    rows = batch.orderBy("ts").collect()
    for epoch in range(5):
        body(spark.createDataFrame(rows[60 * epoch:60 * epoch + 60], batch.schema), epoch)
        body(spark.createDataFrame(rows[60 * epoch:60 * epoch + 60], batch.schema), epoch)   # retried
        assert current_version(spark, win).count() == min(250, 60 * epoch + 60)
        assert spark.read.parquet(ops2).count() == (0 if epoch == 0 else 2)
    fb = f"{tmpdir_path}/fb"
    spark.createDataFrame([("safe.com", "benign", "f", dt.datetime(2024, 1, 30))] * 6,
                          "domain string, true_label string, family string, created_at timestamp_ntz").write.parquet(fb)
    lists, audit = f"{tmpdir_path}/lists", f"{tmpdir_path}/audit"
    ST.feedback_refresh_batch(lists, fb, audit, "2024-01-31 00:00:00")(batch, 7)
    ST.feedback_refresh_batch(lists, fb, audit, "2024-01-31 00:00:00")(batch, 7)   # retried
    cur = ST.current_lists(spark, lists).collect()
    assert [(r["list_name"], r["entry"]) for r in cur] == [("whitelist:auto", "safe.com")]
    assert [r["action"] for r in spark.read.parquet(audit).collect()] == ["auto_whitelist_promote"]
    assert ST.capped_log(spark.createDataFrame([(f"r{i}", dt.datetime(2024, 1, 1, 0, i)) for i in range(5)],
                                               "run_id string, timestamp timestamp"), 2).count() == 2
