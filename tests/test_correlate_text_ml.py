"""Correlation (chunk + halo, hot key), rate limits, text retrieval and
evaluation metrics against brute force on small fixtures."""

import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from dnsglass.operators import correlate as C
from dnsglass.operators import ml as ML
from dnsglass.operators import search as SE


def _events(spark, n=600, seed=1):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ip = "10.0.0.1" if rnd.random() < 0.4 else f"10.0.0.{rnd.randint(2, 6)}"   # one hot key
        # cluster times around hour boundaries to exercise the halo copies
        t = base + dt.timedelta(hours=rnd.randint(0, 5), seconds=rnd.choice([rnd.randint(0, 3599), 3599 - rnd.randint(0, 400),
                                                                               rnd.randint(0, 400)]))
        rows.append((str(i), ip, t, rnd.random()))
    return rows, spark.createDataFrame(rows, "event_id string, src_ip string, ts timestamp_ntz, score double")


def test_correlate_counts_brute_force(spark):
    rows, df = _events(spark)
    got = {r["event_id"]: r["correlated_count"] for r in C.correlate(df, 300).collect()}
    for eid, ip, t, _ in rows:
        want = sum(1 for _, ip2, t2, _ in rows if ip2 == ip and abs((t2 - t).total_seconds()) <= 300)
        assert got[eid] == want, eid


def test_correlate_one_source_in_one_hour(spark):
    """200,000 events of one source within an hour: the cost must not follow the window's size."""
    n = 200_000
    df = spark.range(n).select(
        F.lit("10.0.0.1").alias("src_ip"), F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 3600.0 / {n})").alias("ts"),
        F.concat(F.lit("d"), (F.col("id") % 977).cast("string"), F.lit(".com")).alias("domain"), F.lit(10).alias("response_size"))
    counts = C.correlate(df, 300).agg(F.min("correlated_count"), F.max("correlated_count")).first()
    assert tuple(counts) == (16667, 33333)
    top = C.sliding_domain_features(df, 120).agg(F.max("win_queries"), F.max("win_domains"), F.max("win_response_bytes")).first()
    assert tuple(top) == (6667, 977, 66670)


def test_sliding_features_brute_force(spark):
    rows, df = _events(spark, 400, 9)
    rnd = random.Random(4)
    doms = {e: rnd.choice(["a.com", "bb.com", "xyz.net", None]) for e, *_ in rows}
    size = {e: rnd.choice([None, 5, 70]) for e, *_ in rows}
    extra = spark.createDataFrame([(e, doms[e], size[e]) for e in doms], "event_id string, domain string, response_size int")
    got = {r["event_id"]: r for r in C.sliding_domain_features(df.join(extra, "event_id"), 120).collect()}
    for eid, ip, t, _ in rows:
        near = [e for e, ip2, t2, _ in rows if ip2 == ip and 0 <= (t - t2).total_seconds() <= 120]
        sizes = [size[e] for e in near if size[e] is not None]
        r = got[eid]
        assert (r["win_queries"], r["win_domains"]) == (len(near), len({doms[e] for e in near if doms[e]}))
        assert r["win_response_bytes"] == (sum(sizes) if sizes else None)


def test_correlated_events_brute_force(spark):
    rows, df = _events(spark, 300, 5)
    anchors = df.where(F.col("score") > 0.8).select("event_id")
    got = {}
    for r in C.correlated_events(df, anchors, 600, n=4).collect():
        got.setdefault(r["anchor_id"], []).append((r["rank"], r["event_id"]))
    for eid, ip, t, s in rows:
        if s <= 0.8:
            continue
        cand = sorted(((t2, e2) for e2, ip2, t2, _ in rows
                       if ip2 == ip and e2 != eid and abs((t2 - t).total_seconds()) <= 600), reverse=True)[:4]
        assert [e for _, e in sorted(got.get(eid, []))] == [e for _, e in cand], eid


def test_triage_branches(spark):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(f"a{i}", "10.1.1.1", t + dt.timedelta(seconds=30 * i), 0.1) for i in range(5)]
    rows += [(f"b{i}", "10.1.1.2", t + dt.timedelta(seconds=30 * i), 0.1) for i in range(3)]
    rows += [("c0", "10.1.1.3", t, 0.96), ("d0", "10.1.1.4", t, 0.75), ("e0", "10.1.1.5", t, 0.2)]
    df = spark.createDataFrame(rows, "event_id string, src_ip string, ts timestamp_ntz, score double")
    got = {r["event_id"]: (r["triage_severity"], r["triage_confidence"]) for r in C.triage(df, 300).collect()}
    assert got["a0"] == ("CRITICAL", 0.95) and got["b0"] == ("HIGH", 0.85)
    assert got["c0"] == ("CRITICAL", 0.95) and got["d0"] == ("MEDIUM", 0.7) and got["e0"] == ("LOW", 0.5)


def test_rate_limits(spark):
    t = dt.datetime(2024, 1, 1)
    offs = [0, 10, 20, 30, 59, 60, 61, 70, 130, 131]
    rows = [("k", i, t + dt.timedelta(seconds=o)) for i, o in enumerate(offs)]
    df = spark.createDataFrame(rows, "key string, request_id long, ts timestamp_ntz")
    shared = {r["request_id"]: r["allowed"] for r in C.rate_limit(df, "key", 3, 60).collect()}
    strict = {r["request_id"]: r["allowed"] for r in C.rate_limit_strict(df, "key", 3, 60).collect()}
    # brute force of both definitions
    times = [float(o) for o in offs]
    want_shared = {i: sum(1 for u in times if t0 - 60 < u <= t0) <= 3 for i, t0 in enumerate(times)}
    acc, want_strict = [], {}
    for i, t0 in enumerate(times):
        ok = sum(1 for u in acc if u > t0 - 60) < 3
        want_strict[i] = ok
        if ok:
            acc.append(t0)
    assert shared == want_shared and strict == want_strict
    assert shared != strict  # rejected calls count in one and not the other (Q28)


def test_chunking_literal(spark):
    df = spark.createDataFrame([(1, "x" * 250), (2, "")], "doc_id int, text string")
    out = SE.chunk_documents(df, size=100, overlap=20).orderBy("doc_id", "chunk_id").collect()
    assert [(r["chunk_id"], len(r["content"])) for r in out] == [(0, 100), (1, 100), (2, 90), (3, 10)]


# md5 prefixes worked out by hand for the text "ab" (its word, its only 3-gram and the whole are all "ab"):
# md5("ab") = 187ef4436122d1cc..., so bucket 0x187ef4436122d1cc % 768 with sign + (top bit 0)
AB_BUCKET = 0x187EF4436122D1CC % 768


def test_hash_embed_literal_and_properties(spark):
    texts = ["ab", "  AB ", "DGA domains use random labels", "labels random use domains DGA", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    emb = {r["doc_id"]: np.array(r["embedding"], dtype=float) for r in SE.hash_embed(df, "doc_id", "text").collect()}
    assert emb[0][AB_BUCKET] == 1.0 and np.count_nonzero(emb[0]) == 1
    assert np.array_equal(emb[0], emb[1])                       # case and outer space do not matter
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in emb.values())
    assert 0.3 < float(emb[2] @ emb[3]) < 1.0                   # same words in another order: near, not equal
    assert np.array_equal(emb[4], emb[5])                       # empty like missing


def _strict(rows, limit, w):
    """The limiter, one request after the other."""
    from collections import defaultdict
    acc, out = defaultdict(list), {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [x for x in acc[k] if x > t - dt.timedelta(seconds=w)]
        out[i] = len(live) < limit
        acc[k] = live + [t] if out[i] else live
    return out


def test_strict_limiter_equals_the_sequential_one(spark):
    rnd = random.Random(17)
    t0, rows = dt.datetime(2024, 1, 1), []
    for k in ("hot", "calm", None, "burst"):
        t = 0.0
        for _ in range(700):
            t += rnd.choice([0, 0.5, 3, 20]) if k != "calm" else 40
            if k == "burst" and rnd.random() < 0.02:
                t += 300
            rows.append((k, len(rows), t0 + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "key string, request_id int, ts timestamp_ntz").repartition(5)
    for limit, w in ((1, 30), (3, 60), (12, 60), (700, 60)):
        got = {r["request_id"]: r["allowed"] for r in C.rate_limit_strict(df, "key", limit, w).collect()}
        assert got == _strict(rows, limit, w), (limit, w)


def test_strict_limiter_spreads_a_hot_key(spark):
    """One key, over its limit at times: its requests are decided in many partitions."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", i, t0 + dt.timedelta(seconds=(i // 20) * 100 + i % 20)) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, request_id int, ts timestamp_ntz")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = C.rate_limit_strict(df, "key", 10, 30).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("allowed").cast("int")).alias("a")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) >= 6 and max(r["n"] for r in out) < 1500 and sum(r["a"] for r in out) == 2000


def test_text_and_vector_search_at_many_queries(spark):
    """Stored indexes against brute force: ties, repeated rows, zero vectors, many queries, pruned shards."""
    from dnsglass.operators import textindex as TI
    from dnsglass.operators import vecindex as VI
    rnd = np.random.default_rng(8)
    vecs = np.vstack([rnd.normal(size=(300, 8)) + 6 * rnd.normal(size=(1, 8)) for _ in range(5)] + [np.zeros((3, 8))])
    vecs[10] = vecs[11]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id int, embedding array<double>").repartition(6)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs) if i % 3 == 0 or i > 1498], "query_id int, embedding array<double>")
    unit = np.divide(vecs, np.linalg.norm(vecs, axis=1, keepdims=True), out=np.zeros_like(vecs), where=vecs.any(axis=1, keepdims=True))
    got = {}
    for r in SE.knn_cosine(queries, corpus, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    for q in {r["query_id"] for r in queries.collect()}:
        s = np.round((1 + unit @ unit[q]) / 2, 9)
        assert [got[q][i] for i in range(1, 5)] == sorted(range(len(vecs)), key=lambda i: (-s[i], i))[:4], q
    words = [f"w{i}" for i in range(60)]
    p = random.Random(4)
    texts = [" ".join(p.choices(words, weights=[1 / (1 + i) for i in range(60)], k=p.randint(0, 40))) for _ in range(500)] + ["w59 w58 w57"] * 3 + [None]
    index_path = SE._scratch(corpus, "test")
    old = TI.SHARD_ROWS
    TI.SHARD_ROWS = 64
    try:
        index = TI.write_text_index(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, content string").repartition(3), index_path, "doc_id", buckets=3)
    finally:
        TI.SHARD_ROWS = old
    qs = [(i, " ".join(p.choices(words, k=p.randint(1, 5)))) for i in range(60)] + [(100, "w59 w58 w57"), (101, "nothing known")]
    hits = {}
    for r in TI.bm25_search(spark.createDataFrame(qs, "query_id int, text string"), index, 5, id_col="doc_id", query_block=7).collect():
        hits.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], round(r["score"], 6))
    toks = [(t or "").split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    df_of = {w: sum(w in t for t in toks) for w in words}
    for q, text in qs:
        scores = []
        for i, t in enumerate(toks):
            s = 0.0
            for w in text.split():
                tf = t.count(w)
                if tf:
                    s += math.log(1 + (len(toks) - df_of[w] + .5) / (df_of[w] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(t) / avg))
            if s > 0:
                scores.append((-round(s, 9), i))
        assert [(i, round(-s, 6)) for s, i in sorted(scores)[:5]] == [hits[q][k] for k in sorted(hits.get(q, {}))], q


def test_knn_matches_exact_cosines(spark):
    rnd = np.random.default_rng(3)
    vecs, qs = rnd.normal(size=(40, 768)), rnd.normal(size=(3, 768))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id int, embedding array<double>")
    query = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(qs)], "query_id int, embedding array<double>")
    got = {}
    for r in SE.knn_cosine(query, corpus, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    for i, q in enumerate(qs):
        cos = vecs @ q / np.linalg.norm(vecs, axis=1)
        assert got[100 + i] == np.argsort(-cos)[:3].tolist()


def test_bm25_brute_force(spark):
    import re
    docs = ["the cat sat on the mat", "dogs and cats", "the quick brown fox", "cat cat cat", "nothing here"]
    corpus = spark.createDataFrame([(f"c{i}", d) for i, d in enumerate(docs)], "chunk_key string, content string")
    q = spark.createDataFrame([(1, "the cat")], "query_id int, text string")
    got = {r["chunk_key"]: r["score"] for r in SE.bm25(q, corpus, 10).collect()}
    toks = [re.findall(r"\w+", d.lower()) for d in docs]
    avg = sum(map(len, toks)) / len(toks)

    def score(ts):
        s = 0.0
        for term in ["the", "cat"]:
            n = sum(1 for d in toks if term in d)
            idf = math.log(1 + (len(toks) - n + 0.5) / (n + 0.5))
            tf = ts.count(term)
            if tf:
                s += idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(ts) / avg))
        return s
    want = {f"c{i}": score(t) for i, t in enumerate(toks) if score(t) > 0}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_roc_auc_matches_pairwise(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([0, 1]), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "truth int, prob double")
    auc = ML.roc_auc(df).first()["auc"]
    pos = [p for t, p in rows if t == 1]
    neg = [p for t, p in rows if t == 0]
    want = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-9
    assert abs(auc - ML.binary_auc_spark(df)) < 1e-9


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "truth int, pred int")
    out = {r["cls"]: r for r in ML.classification_metrics(df).collect()}
    assert out["1"]["tp"] == 2 and out["1"]["fn"] == 1 and out["1"]["precision"] == 1.0
    assert abs(out["1"]["recall"] - 2 / 3) < 1e-12 and abs(out["accuracy"]["precision"] - 0.8) < 1e-12


def test_ml_queries_train_the_default_models_once(spark, sf001, monkeypatch):
    """No query trains a smaller model than the operators' defaults, and one model serves all."""
    from unittest.mock import MagicMock

    from dnsglass.plans import q_ml
    ml = MagicMock()
    for name in ("train_binary", "train_family"):
        train = getattr(ml, name)
        train.__name__, train.return_value = name, (MagicMock(), MagicMock())
    monkeypatch.setattr(q_ml, "ML", ml)
    monkeypatch.setattr(q_ml, "_trained", {}, raising=False)
    for query in (q_ml.train_binary, q_ml.score_binary, q_ml.train_family, q_ml.classify_family, q_ml.score_two_stage, q_ml.cross_validate):
        query(spark, sf001)
    for train in (ml.train_binary, ml.train_family, ml.cross_validate):
        assert train.call_count == 1
        assert len(train.call_args.args) == 1 and not train.call_args.kwargs


def _family_rows(n=240):
    """Families that differ in their letters alone: same lengths, classes and entropy."""
    rnd = random.Random(23)
    alphabets = {"fam-a": "bcdfgh", "fam-b": "jklmnp", "fam-c": "qrstvw"}
    rows = []
    for i in range(n):
        name, letters = list(alphabets.items())[i % 3]
        rows.append(("".join(rnd.choice(letters) for _ in range(10)) + f"{i % 10}.com", 1, name))
    return rows + [(f"site{i}.org", 0, "alexa") for i in range(20)]


def test_family_model_reads_character_ngrams(spark, capsys):
    df = spark.createDataFrame(_family_rows(), "domain string, target int, family string")

    def accuracy(scored, model):
        names = ML.family_labels(model)
        rows = scored.select("family", "prediction").collect()
        return sum(int(r["prediction"]) < len(names) and names[int(r["prediction"])] == r["family"] for r in rows) / len(rows)
    model, scored = ML.train_family(df, max_iter=30)
    with_grams = accuracy(scored, model)
    bare, plain = ML.train_family(df.withColumn("same", F.lit("x")), max_iter=30, grams=1)   # one bucket: no n-gram information
    without = accuracy(plain, bare)
    with capsys.disabled():
        print(f"\nfamily model, held-out accuracy: {with_grams:.3f} with character n-grams, {without:.3f} without")
    assert with_grams > 0.95 and with_grams > without + 0.2
    top = ML.classify_family(spark.createDataFrame([("bcdfghbcdf1.com",)], "domain string"), model, only_dga=False).first()["top_families"]
    assert top[0]["family"] == "fam-a"


def test_pca_spans_the_subspace_of_a_dense_svd(spark):
    from dnsglass.operators import ngram as NG
    rows = _family_rows(90)
    df = spark.createDataFrame(rows, "domain string, target int, family string").repartition(4)
    vectors, terms = NG.ngram_vectors(df.select("domain", "family"), df.select("domain"))
    width = terms.count()
    x, names = np.zeros((len(rows), width)), []
    for i, r in enumerate(vectors.orderBy("domain").collect()):
        x[i, r["indices"]] = r["values"]
        names.append(r["domain"])
    assert np.allclose(np.linalg.norm(x, axis=1), np.sqrt(3))
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[:2].T
    got = ML.pca_ngrams(df.select("domain", "family").withColumn("family", F.col("domain")), 2, "family", rounds=40).orderBy("family").collect()
    assert [r["family"] for r in got] == names
    have = np.array([[r["pc1"], r["pc2"]] for r in got])
    for j in range(2):
        sign = np.sign(have[:, j] @ want[:, j])
        assert np.abs(sign * have[:, j] - want[:, j]).max() < 0.02 * np.abs(want[:, j]).max()
