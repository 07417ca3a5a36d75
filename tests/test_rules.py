"""Lists, thresholds, routing and scoring rules with literal rows."""

from pyspark.sql import functions as F

from dnsglass.operators import rules as RU


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, domain string, score double, is_dga boolean, "
                                       "severity string, tenant_id string")


def test_allowlist_static_and_dynamic(spark):
    ev = _events(spark, [("1", "google.com", 0.9, True, "HIGH", "default"),
                         ("2", "evil.xyz", 0.9, True, "HIGH", "default"),
                         ("3", "mail.corp.net", 0.8, True, "MEDIUM", "default")])
    lists = spark.createDataFrame([("whitelist:auto", "corp.net", "fb")], "list_name string, entry string, source string")
    out = {r["event_id"]: r for r in RU.allowlist(ev, ["google.com"], lists).collect()}
    assert out["1"]["score"] == 0.0 and out["1"]["is_dga"] is False and out["1"]["rules_applied"] == ["whitelist:static"]
    assert out["1"]["severity"] == "HIGH"  # allow list does not touch severity (Q5)
    assert out["2"]["score"] == 0.9 and out["2"]["rules_applied"] == []
    assert out["3"]["rules_applied"] == ["whitelist:dynamic"]


def test_denylist_then_threshold_rewrites(spark):
    ev = _events(spark, [("1", "bad.example.org", 0.2, False, "LOW", "default")])
    out = RU.denylist(ev, ["example.org"], None)
    r = out.first()
    assert r["score"] == 1.0 and r["severity"] == "CRITICAL" and r["rules_applied"] == ["blacklist:static"]
    r2 = RU.apply_threshold(out, 0.7).first()
    assert r2["severity"] == "CRITICAL" and r2["rules_applied"] == ["blacklist:static", "threshold:0.7"]


def test_threshold_rows(spark):
    ev = _events(spark, [("a", "x.com", 0.9, None, None, "default"), ("b", "y.com", 0.3, None, None, "default"),
                         ("c", "z.com", 0.6, None, None, "finance")])
    out = {r["event_id"]: r for r in RU.apply_threshold(ev, 0.7, {"finance": 0.5}).collect()}
    assert out["a"]["is_dga"] is True and out["a"]["severity"] == "HIGH"
    assert out["b"]["is_dga"] is False and out["b"]["severity"] == "LOW"
    assert out["c"]["is_dga"] is True and out["c"]["severity"] == "MEDIUM" and out["c"]["threshold"] == 0.5


def test_score_route_boundary(spark):
    ev = spark.createDataFrame([(0.9,), (0.3,), (0.7,), (None,)], "score double")
    got = [r["branch"] for r in RU.score_route(ev, 0.7, "high", "low").collect()]
    assert got == ["high", "low", "high", "low"]


def test_ensemble_rows(spark):
    df = spark.createDataFrame([(0, 0.1, None, None), (1, 0.9, "qakbot", 0.85), (1, 0.3, "x", 0.9),
                                (1, 0.9, "necurs", 0.8)],
                               "label int, p double, top_family string, top_confidence double")
    unweighted = RU.ensemble_score(df.limit(3), threshold=0.5, weights=None).collect()
    assert unweighted[0]["family"] is None and unweighted[0]["is_dga"] is False and unweighted[0]["score"] == 0.1
    assert unweighted[1]["family"] == "qakbot" and unweighted[1]["family_confidence"] == 0.85
    assert unweighted[2]["family"] is None and unweighted[2]["is_dga"] is True
    w = RU.ensemble_score(df, threshold=0.5, weights=(0.6, 0.4)).collect()[3]
    assert abs(w["score"] - min(1.0, 0.9 * 0.6 + 0.8 * 0.4)) < 1e-9


def test_list_match_suffix_and_regex(spark):
    ev = spark.createDataFrame([("a.b.evil.com",), ("evil.com",), ("notevil.com",), ("good.org",)], "domain string")
    lst = spark.createDataFrame([("evil.com",)], "entry string")
    hit = {r["domain"]: r["list_hit"] for r in RU.list_match(ev, lst, "suffix", "pass").collect()}
    assert hit == {"a.b.evil.com": True, "evil.com": True, "notevil.com": False, "good.org": False}
    kept = sorted(r["domain"] for r in RU.list_match(ev, lst, "suffix", "drop").collect())
    assert kept == ["good.org", "notevil.com"]
    rx = {r["domain"]: r["list_hit"] for r in RU.list_match(ev, [r"^a\.", r"\.org$"], "regex", "pass").collect()}
    assert rx == {"a.b.evil.com": True, "evil.com": False, "notevil.com": False, "good.org": True}


def test_route_targets(spark):
    ev = _events(spark, [("1", "a", 0.99, True, "CRITICAL", "d"), ("2", "b", 0.1, False, "LOW", "d")])
    out = sorted((r["event_id"], r["target"]) for r in
                 RU.route(ev, ["es:always", "kafka:is_dga", "olap:high_severity"], "es").collect())
    assert out == [("1", "es"), ("1", "kafka"), ("1", "olap"), ("2", "es")]


def test_response_actions_and_intent(spark):
    ev = spark.createDataFrame([("e1", "CRITICAL", "x.com", "10.0.0.1"), ("e2", "LOW", "", "10.0.0.2")],
                               "event_id string, severity string, domain string, src_ip string")
    acts = RU.response_actions(ev).collect()
    assert [a["action"] for a in acts if a["event_id"] == "e1"] == ["block_dns", "isolate_host", "create_incident",
                                                                    "log_event"]
    low = [a for a in acts if a["event_id"] == "e2"][0]
    assert low["target"] == "10.0.0.2" and low["auto_execute"] is True and low["level"] == "medium"
    t = spark.createDataFrame([("最近的告警趋势",), ("hello",), ("如何部署",)], "q string")
    got = [r["c"].asDict() for r in t.select(RU.classify_intent(F.col("q")).alias("c")).collect()]
    assert got == [{"intent": "query", "confidence": 0.6}, {"intent": "query", "confidence": 0.3},
                   {"intent": "operate", "confidence": 0.6}]


def test_geo_overlaps_and_intel_ties(spark):
    from dnsglass.operators import rules as RU
    ev = spark.createDataFrame([("a", 5, "x.com"), ("b", 70_000, "y.com"), ("c", 99_999_999, "z.com"), ("d", None, None), ("e", 5, "x.com")],
                               "event_id string, ip_long long, domain string")
    ranges = spark.createDataFrame([(0, 200_000, "WIDE", "w", 1), (1, 9, "NARROW", "n", 2), (0, 8, "NARROW0", "n0", 3), (69_999, 70_001, "IRAN", "i", 4)],
                                   "start_ip long, end_ip long, country string, city string, asn long")
    got = {r["event_id"]: (r["country"], r["asn"], r["geo_high_risk"]) for r in RU.geo_enrich(ev, ranges).collect()}
    assert got == {"a": ("NARROW0", 3, False), "e": ("NARROW0", 3, False), "b": ("IRAN", 4, True), "c": (None, None, False), "d": (None, None, False)}
    intel = spark.createDataFrame([("x.com", 0.9, "f2"), ("x.com", 0.1, "f9"), ("y.com", 0.5, "f1")], "domain string, reputation double, malware_family string")
    got = {r["event_id"]: (r["reputation"], r["malware_family"]) for r in RU.intel_enrich(ev, intel).collect()}
    assert got["a"] == got["e"] == (0.1, "f9") and got["b"] == (0.5, "f1") and got["c"] == (None, None)
    assert RU.intel_enrich(ev, intel, fail_open=False).count() == 3
