"""Grouped alerts, reports, dashboard and feedback / drift loops on literal rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dnsglass.operators import alerts as A
from dnsglass.operators import drift as DR
from dnsglass.operators import feedback as FB
from dnsglass.operators import reports as R

EV = ("event_id string, domain string, src_ip string, severity string, score double, family string, "
      "ts timestamp_ntz, acknowledged boolean, is_dga boolean, pipeline_id string")


def test_alerts_grouped(spark):
    t0 = dt.datetime(2024, 3, 15, 10, 0)
    rows = []
    sev = ["CRITICAL"] * 10 + ["HIGH"] * 20 + ["LOW"] * 17
    for i, s in enumerate(sev):
        rows.append((f"a{i}", "evil.com", "10.0.0.1" if i % 2 else "10.0.0.2", s, 0.5 + i / 100, "necurs",
                     t0 + dt.timedelta(minutes=i), False, True, None))
    for i in range(3):
        rows.append((f"b{i}", "other.com", "10.0.0.3", "HIGH", 0.9, None, t0, True, True, None))
    df = spark.createDataFrame(rows, EV)
    out = A.alerts_by_domain(df).collect()
    assert [r["domain"] for r in out] == ["evil.com", "other.com"]
    e = out[0]
    assert e["alert_count"] == 47 and e["max_severity"] == "CRITICAL" and e["unique_src_ip_count"] == 2
    assert set(e["unique_src_ips"]) == {"10.0.0.1", "10.0.0.2"} and e["family"] == "necurs"
    assert e["all_acknowledged"] is False
    o = out[1]
    assert o["alert_count"] == 3 and o["all_acknowledged"] is True and o["family"] is None


def test_alert_filter_sources(spark):
    rows = [("1", "a.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), None, False, None),
            ("2", "b.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), None, False, "gateway"),
            ("3", "c.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), None, False, "dga-v1"),
            ("4", "d.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), None, False, "")]
    df = spark.createDataFrame(rows, EV)
    manual = sorted(r["event_id"] for r in A.alert_filter(df, source="manual").collect())
    dag = sorted(r["event_id"] for r in A.alert_filter(df, source="dag").collect())
    assert manual == ["1", "2"] and dag == ["3", "4"]
    assert A.alert_filter(df).count() == 4


def test_trend_labels_and_density(spark):
    rows = []
    for day, total, dga in ((15, 100, 40), (17, 200, 80)):
        for i in range(total):
            rows.append((str(day * 1000 + i), "x", "1", "LOW", 0.1, None, dt.datetime(2024, 3, day, 1), None, i < dga, None))
    df = spark.createDataFrame(rows, EV)
    out = R.daily_trend(df, start="2024-03-01 00:00:00").orderBy("day").collect()
    assert [(r["date"], r["total"], r["dga"]) for r in out] == [("3/15", 100, 40), ("3/16", 0, 0), ("3/17", 200, 80)]


def test_heatmap_168(spark):
    mon = dt.datetime(2024, 1, 1, 14, 5)   # Monday
    tue = dt.datetime(2024, 1, 2, 9, 0)
    rows = [(str(i), "x", "1", "LOW", 0.1, None, mon, None, False, None) for i in range(8)]
    rows += [(str(100 + i), "x", "1", "LOW", 0.1, None, tue, None, False, None) for i in range(10)]
    out = R.heatmap(spark.createDataFrame(rows, EV)).collect()
    assert len(out) == 168
    cells = {(r["hour"], r["weekday"]): r["count"] for r in out}
    assert cells[(14, 0)] == 8 and cells[(9, 1)] == 10 and sum(cells.values()) == 18


def test_qps_drops_empty_buckets(spark):
    base = dt.datetime(2024, 1, 30, 23, 10)
    rows = [(str(i), "x", "1", "LOW", 0.1, None, base + dt.timedelta(minutes=2 * (i // 5)), None, i % 5 < 3, None)
            for i in range(10)]
    out = R.qps_history(spark.createDataFrame(rows, EV), "2024-01-31 00:00:00").orderBy("bucket").collect()
    assert [(r["time"], r["qps"], r["hits"]) for r in out] == [("23:10", 5, 3), ("23:12", 5, 3)]
    assert all(r["level"] == 1 for r in out)


def test_feedback_promotion(spark):
    t = dt.datetime(2024, 1, 30)
    rows = [("safe.com", "benign", "fam", t)] * 6 + [("bad.com", "dga", "fam", t)] * 3 + \
           [("mixed.com", "dga", "fam", t)] * 4 + [("mixed.com", "benign", "fam", t)]
    fb = spark.createDataFrame(rows, "domain string, true_label string, family string, created_at timestamp_ntz")
    got = sorted((r["list_name"], r["entry"]) for r in FB.promote_lists(fb, "2024-01-31 00:00:00").collect())
    assert got == [("blacklist:auto", "bad.com"), ("whitelist:auto", "safe.com")]
    old = spark.createDataFrame([("whitelist:auto", "old.com")], "list_name string, entry string")
    diff = sorted((r["action"], r["resource"]) for r in FB.list_diff(FB.promote_lists(fb, "2024-01-31 00:00:00"), old).collect())
    assert diff == [("auto_blacklist_promote", "bad.com"), ("auto_whitelist_demote", "old.com"),
                    ("auto_whitelist_promote", "safe.com")]


def test_family_recommendation(spark):
    t = dt.datetime(2024, 1, 30)
    rows = [("d.com", "benign" if i < 8 else "dga", "noisy", t) for i in range(25)]
    rows += [("e.com", "dga", "clean", t) for _ in range(25)]
    fb = spark.createDataFrame(rows, "domain string, true_label string, family string, created_at timestamp_ntz")
    out = FB.family_fp_rate(fb, None, "2024-01-31 00:00:00").collect()
    assert [(r["family"], r["fp_rate"], r["n_samples"]) for r in out] == [("noisy", 0.32, 25)]


def test_psi_alert_and_identity(spark):
    rnd = random.Random(3)
    base = spark.createDataFrame([(rnd.uniform(0, 0.3), float(rnd.randint(8, 20))) for _ in range(200)],
                                 "score double, domain_len double")
    cur = spark.createDataFrame([(rnd.uniform(0.7, 1.0), float(rnd.randint(40, 80))) for _ in range(200)],
                                "score double, domain_len double")
    scores = {r["feature"]: r["psi"] for r in DR.psi(base, cur, ["score", "domain_len"]).collect()}
    assert scores["score"] >= 0.25 and scores["domain_len"] >= 0.25
    same = {r["feature"]: r["psi"] for r in DR.psi(base, base, ["score", "domain_len"]).collect()}
    assert all(abs(v) < 1e-12 for v in same.values())
    alerts = DR.drift_alerts(DR.psi(base, cur, ["score"])).collect()
    assert alerts[0]["operation"] == "drift_alert" and alerts[0]["status"] == "pending"
    small = spark.createDataFrame([(0.5, 1.0)] * 50, "score double, domain_len double")
    assert DR.psi(base, small, ["score"]).count() == 0  # fewer than 100 window rows


def test_acknowledge_idempotent(spark):
    rows = [("1", "a.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), False, True, None),
            ("2", "a.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), True, True, None),
            ("3", "b.com", "1", "LOW", 0.1, None, dt.datetime(2024, 1, 1), False, True, None)]
    df = spark.createDataFrame(rows, EV)
    req = spark.createDataFrame([("a.com",)], "domain string")
    snap = A.acknowledge(df, domains=req)
    assert snap.where("updated").count() == 1
    again = A.acknowledge(snap.drop("updated"), domains=req)
    assert again.where("updated").count() == 0
