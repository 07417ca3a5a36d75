"""Dedup, near-dedup, decontamination, quality, fingerprints, URL lists, pipeline."""

import datetime as dt
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsglass.llm import components, decontaminate, minhash, quality, spotsigs, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"{rng.choice('bcdfg')}{rng.randint(0, size)}{rng.choice('xyz')}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, odd and long rows."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(160):
        own = words(rng, rng.choice([3, 8, 40, 120, 300]))
        kind = i % 8
        if kind == 1 and out:
            own = rng.choice(out)[1].split()
        elif kind == 2 and out:
            own = rng.choice(out)[1].split()
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = "edited"
        text = " ".join(own)
        if kind in (3, 4):
            k = rng.randint(0, len(own))
            text = " ".join(own[:k]) + " é" * (i % 3) + passage + " ".join(own[k:])
        out.append((i * 3, text))
    out += [(1000, ""), (1001, " \t\n"), (1002, "One"), (1003, "one"), (1004, "a" * 5000), (1005, "ab" * 3000), (1006, "ü" * 400), (1007, " ".join(words(rng, 30000))), (1008, "ü" * 400)]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "s", len(t)) for i, t in corpus] + [(2000, None, None, None, None), (9, dict(corpus)[9], "en", "s", 5)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("doc", F.lit("clash")).withColumn("key", F.lit(7))


def brute_removed(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p:p + length] in seen:
                gone[p:p + length] = True
            seen.add(b[p:p + length])
        out[d] = (b, gone)
    return out


def test_suffix_dedup(spark, docs, corpus):
    expected = brute_removed(corpus, 100)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        b, gone = expected.get(r["doc_id"], (b"", np.zeros(0, bool)))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), r
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_suffix_dedup_of_crowded_keys(spark, corpus, monkeypatch):
    """A passage in many different surroundings: more different pieces than are sorted as one text."""
    rng = random.Random(4)
    passage = " ".join(words(rng, 40))
    rows = [(i, " ".join(words(rng, 12)) + passage[:rng.randint(150, 240)] + " ".join(words(rng, 12))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_removed(rows, 100)
    for r in suffix_dedup.remove_repeats(docs).collect():
        assert r["n_removed"] == int(expected[r["doc_id"]][1].sum())
    assert suffix_dedup.settle(suffix_dedup.pieces(docs.select("doc_id", "text"))).filter(F.col("kind") == suffix_dedup.SPLIT).count() > 0


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    rng = random.Random(6)
    part = " ".join(words(rng, 900))
    rows = [(1, part + " ".join(words(rng, 900)) + part), (2, part[500:3000])]
    expected = brute_removed(rows, 100)
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    for chunk in (1000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
        import pyarrow as pa
        seen = set()
        for a, d, off, ends, shift in suffix_dedup._views(pa.array([t for _, t in rows]), 100):
            first, size, _, _ = suffix_dedup.find_pieces(d, ends)
            for f, s in zip(first, size):
                row = a + np.searchsorted(off, f, "right") - 1
                seen |= {(row, int(x + shift[row - a] - off[row - a])) for x in range(f, f + s)}
        assert seen == {(i, p) for i, d in enumerate(data) for p in range(len(d) - 99)}
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: int(g.sum()) for d, (_, g) in expected.items()}


def test_without_repeats(spark, docs, corpus):
    got = suffix_dedup.without_repeats(docs)
    assert got.schema == docs.schema
    expected = brute_removed(corpus, 100)
    for r in got.collect():
        if r["text"] is None:
            assert r["doc_id"] == 2000
            continue
        b, gone = expected[r["doc_id"]]
        whole, at = [], 0
        for c in b.decode():
            n = len(c.encode())
            whole.append("" if gone[at:at + n].all() else c)
            at += n
        assert r["text"] == "".join(whole) and r["n_chars"] == len(r["text"]) and r["doc"] == "clash"


def test_suffix_dedup_of_rows_without_an_id_of_their_own(spark):
    """Null ids, and ids with several texts: every text is a document of its own."""
    rng = random.Random(15)
    shared, border = [" ".join(words(rng, n)) for n in (50, 70)]
    rows = [(None, " ".join(words(rng, 300))), (None, shared), (None, "short"), (None, ""), (None, None), (7, shared + " ".join(words(rng, 20))), (7, shared), (7, shared),
            (7, " ".join(words(rng, 5)) + shared), (7, None), (8, "é" + " ".join(words(rng, 30))), (8, " ".join(words(rng, 200))), (None, shared)]
    # one text repeats what another text of the same id has at the same place
    rows += [(i, border + " ".join(words(rng, 30))) for i in (None, None, 8, 8, 8)]
    # a crowded key: more different pieces than are sorted as one text
    rows += [(rng.choice([None, 9]), " ".join(words(rng, 12)) + border[:rng.randint(150, 240)] + " ".join(words(rng, 12))) for _ in range(100)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(4)
    hashed = docs.select("n", F.xxhash64("text")).collect()
    copy = {rows[n][1]: h for n, h in hashed}
    seen, expected = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is not None, r[0] or 0, copy[r[1]])):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(b[p:p + 100])
        expected[i, t] = bytes(np.frombuffer(b, np.uint8)[~gone])
    assert sum(len(t.encode()) > len(k) for (_, t), k in expected.items()) > 100

    def digests(texts):
        return Counter((i, hashlib.sha256(k).hexdigest()) for i, k in texts)

    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in got) == digests((i, expected.get((i, t), b"")) for i, t in rows)
    for r in suffix_dedup.without_repeats(docs).collect():
        i, t = rows[r["n"]]
        assert (r["doc_id"], r["text"]) == (i, expected[i, t].decode() if t else t)


def brute_groups(rows):
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates(spark, docs, corpus):
    expected = brute_groups(corpus)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        n, c = expected.get(r["doc_id"], (0, r["doc_id"]))
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, c, r["doc_id"] == c)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicate_chains(spark):
    """Links between members of a bucket that are far from the bucket's first."""
    rng = random.Random(8)
    base = words(rng, 60)
    rows, now = [], base
    for i in range(30):
        rows.append((i, " ".join(now)))
        now = list(now)
        now[(7 * i) % 60] = f"new{i}"
    expected = brute_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in expected.items()}


def test_verification_in_blocks(spark):
    rng = random.Random(9)
    base = words(rng, 50)
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(40)] + [(99, " ".join(words(rng, 50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in [*range(1, 40), 99]], "doc long, lead long")
    assert {r["u"] for r in minhash.verified(pairs, docs, block=7).collect()} == set(range(1, 40))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 150: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def fewest_edits(probe, text):
    row = [0] * (len(text) + 1)
    for c in probe:
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, rng.choice([2, 15, 25])))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny"), (None, "no id of its own here")]
    rows = []
    for d in range(60):
        text = " ".join(words(rng, 40))
        if d % 2:
            probe = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, max(1, len(probe) // 8))):
                at = rng.randrange(len(probe))
                probe[at:at + rng.randint(0, 1)] = rng.choice(["q", "", "zz"])
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(probe) + text[at:]
        rows.append((d, text.upper() if d % 3 else text.replace(" ", "\n  ")))
    rows += [(100, None), (101, ""), (7, rows[7][1]), (102, (" ".join(words(rng, 3000)) + " " + items[2][1]) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    expected = set()
    for i, t in items:
        t = decontaminate.normal(t)
        if i is None or len(t) < decontaminate.Q:
            continue
        starts = [0] if len(t) <= 100 else [*range(0, len(t) - 100, 50), len(t) - 100]
        for p in {t[s:s + 100] for s in starts}:
            expected |= {(d, i) for d, x in rows[:61] if x and fewest_edits(p, decontaminate.normal(x)) <= decontaminate.allowed(len(p))}
    expected.add((102, 2))
    for size in (4_000_000, 400):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark, size).collect()}
        assert {x for x in got if x[0] != 102} | {(102, 2)} == expected and (102, 2) in got
    assert decontaminate.contaminated(docs, benchmark.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), benchmark).collect() == []


def test_decontamination_of_excerpts(spark):
    """Verbatim excerpts from every offset of an item, against brute force over all its substrings."""
    rng = random.Random(14)
    items = [(i, " ".join(words(rng, n, 10 ** 6))) for i, n in enumerate((40, 13, 9, 60, 40))] + [(9, "ab" * 90)]
    items.append((5, items[0][1]))  # the same text under another id
    least = decontaminate.EXCERPT
    assert 50 <= least <= 60
    rows = []
    for i, t in items[:4]:
        for at in range(0, len(t) - 10):
            for n in (least - 1, least, least + 9, 135):
                rows.append((len(rows), (" ".join(words(rng, 5)) + "\n" + t[at:at + n].upper() + "  " + " ".join(words(rng, 5)))))
    rows += [(len(rows), "x" + "ba" * 26), (len(rows) + 1, "x" + "ba" * 20 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    holders = defaultdict(set)
    for i, t in items:
        for s in range(len(t) - least + 1):
            holders[t[s:s + least]].add(i)
    expected = set()
    for d, x in rows:
        x = decontaminate.normal(x)
        expected |= {(d, i) for s in range(len(x) - least + 1) for i in holders.get(x[s:s + least], ())}
    for size in (4_000_000, 700):
        got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), size).collect()
        assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
        assert expected <= {(r["doc_id"], r["item_id"]) for r in got}
        assert {(r["doc_id"], r["item_id"]) for r in got if not r["n_probes"]} <= expected
        for r in got:
            if not r["n_probes"]:
                x = decontaminate.normal(rows[r["doc_id"]][1])
                assert r["edits"] == 0 and r["item_id"] in holders[x[r["region_end"] - least:r["region_end"]]]
    assert len(expected) > 1000


def test_banded_alignment():
    rng = random.Random(12)
    for _ in range(200):
        text = "".join(rng.choices("abc", k=60))
        probe = "".join(rng.choices("abc", k=20))
        whole = decontaminate.banded(probe, text, -20, 120, 20)
        assert whole[0] == fewest_edits(probe, text)


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.scores(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [not r["kept"] for r in rows if r["quality"] == 0]
    abuse = [not r["kept"] for r in rows if r["toxic"] == 1 and r["lang"] == "en"]
    assert np.mean(clean) > 0.99 and np.mean(junk) > 0.9 and np.mean(abuse) > 0.97


def test_quality_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(2000, None, None), (None, 1, 1), (3, 1, 1), (3, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = quality.scores(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scores(docs.limit(0), odd).collect() == []
    assert quality.keep_good(docs, odd).schema == docs.schema


def test_toxic_stems_are_all_kept(spark):
    """More stems that pass the tests than any fixed number of the best supported ones."""
    bad = [f"{a}{b}{c}{d}" for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxz" for d in "hjqwyzuo"]  # four letters, a stem each
    rare = ["zyxw", "zyxv"]
    rows = [(i, " ".join(bad + rare * (i < 30))) for i in range(60)] + [(i, "clean words of some text") for i in range(60, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.toxic_stems(docs, labels)
    expected = set().union(*(quality.stems_of({w}) for w in bad + rare))
    assert len(expected) > 2000 and got >= expected


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    bad = rng.random(20000) < 0.2
    right = [0.9, 0.8, 0.0, 0.0, 0.0, 0.95, 0.85]  # of the two kinds that occur here
    kind = rng.random(20000) < 0.5
    votes = np.zeros((20000, 7), int)
    for j in (0, 1):
        votes[:, j] = (bad & kind & (rng.random(20000) < right[j])) | (~bad & (rng.random(20000) < 0.01))
    for j in (5, 6):
        votes[:, j] = np.where((bad & ~kind & (rng.random(20000) < right[j])) | (~bad & (rng.random(20000) < 0.005)), 1, 2)
    pats, n = np.unique(votes, axis=0, return_counts=True)
    table, prior = quality.accuracies(list(zip(pats.tolist(), n.tolist())))
    post = quality.posterior(votes, table, prior)
    assert ((post > 0.5) == bad).mean() > 0.95
    assert abs(table[0, 1, 1] - 0.9) < 0.1 and abs(table[5, 5, 1] - 0.95) < 0.1


def test_fingerprints(spark, corpus, monkeypatch):
    monkeypatch.setattr(spotsigs, "STRETCH", 20)
    rows = [(i, t) for i, t in corpus if i != 1007] + [(2000, None), (None, "no id here at the end of the list")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("next", F.lit(1)).withColumn("stretch", F.lit(1))
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(docs).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [rows[-1]]
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1)
        prints[t].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert spotsigs.fingerprints(docs.limit(0)).collect() == []
    alone = spotsigs.fingerprints(spark.createDataFrame([(5, "the cat sat on the mat and ran far off")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_signatures(spark):
    rows = spark.createDataFrame([("The big red dog ran, and the small cat of Rome slept well.",), ("big red dogs",), ("...",), ("",)], "t string")
    sizes = [r[0] for r in rows.select(F.size(spotsigs.signatures(F.col("t")))).collect()]
    assert sizes == [3, 1, 1, 0]  # the big red dog; the small cat Rome; of Rome slept well


def test_spot_matches(spark):
    rng = random.Random(13)
    anchors = ["the", "of", "and", "is"]
    base = [[w for x in words(rng, 40) for w in (rng.choice(anchors), x)] for _ in range(6)]
    rows = []
    for i in range(40):
        w = list(base[i % 6])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[2 * rng.randrange(40) + 1] = f"new{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = spotsigs.matches(docs, 0.6)
    sets = {r["doc_id"]: set(r["s"]) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    cls = {r["doc_id"]: r["class"] for r in members.collect()}
    assert all(cls[d] == min(e for e in sets if sets[e] == sets[d]) for d in sets)
    tops = sorted(set(cls.values()))
    expected = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in tops for b in tops if a < b}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert got == pytest.approx({k: v for k, v in expected.items() if v >= 0.6})


def test_url_filter(spark):
    day = dt.date
    entries = [("l1", "block", "bad.org", "add", day(2024, 1, 10)), ("l1", "block", "bad.org", "remove", day(2024, 2, 5)), ("l1", "block", "bad.org", "add", day(2024, 3, 1)),
               ("l2", "allow", "ok.bad.org", "add", day(2024, 1, 20)), ("l3", "block", "x.net/ads", "add", day(2024, 1, 1)), ("l3", "block", "x.net", "add", day(2024, 1, 5)),
               ("l4", "allow", "x.net", "add", day(2024, 1, 5)), ("l5", "block", "same.com", "add", day(2024, 1, 1)), ("l5", "block", "same.com", "remove", day(2024, 1, 1)), (None, "block", "x.net", "add", None)]
    captures = [("http://www.BAD.org/a", day(2024, 1, 9), "unlisted"), ("http://bad.org:80/", day(2024, 1, 10), "blocked"), ("https://u@a.b.bad.org", day(2024, 2, 4), "blocked"),
                ("http://bad.org/", day(2024, 2, 5), "unlisted"), ("http://bad.org/", day(2025, 3, 1), "blocked"), ("http://ok.bad.org/q", day(2024, 1, 25), "allowed"),
                ("http://x.net/ads/1?z", day(2024, 2, 1), "blocked"), ("http://x.net/", day(2024, 2, 1), "allowed"), ("http://same.com/", day(2024, 2, 1), "unlisted"),
                (None, day(2024, 2, 1), "unlisted"), ("no url", day(2024, 2, 1), "unlisted"), ("http://bad.org/", None, "unlisted"), ("http://bad.org/", day(2025, 3, 1), "blocked")]
    c = spark.createDataFrame(captures, "url string, fetched date, host string").withColumn("day", F.lit(1)).withColumn("month", F.lit(1))
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, day date")
    got = url_filter.evaluate(c, e).collect()
    assert len(got) == len(captures) and all(r["filter"]["verdict"] == r["host"] for r in got)
    assert {r["filter"]["verdict"] for r in url_filter.evaluate(c, e.limit(0)).collect()} == {"unlisted"}
    assert url_filter.evaluate(c.limit(0), e).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import duckdb
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        ids = {r[0] for r in before.select("doc_id").collect()}
        assert {r[0] for r in out.select("doc_id").collect()} <= ids
        if name == "minhash_near_dedup":
            groups = brute_groups([(r["doc_id"], r["text"] or "") for r in before.collect()])
            assert {r[0] for r in out.select("doc_id").collect()} == {c for _, c in groups.values()}
        if name == "benchmark_decontamination":
            items = [decontaminate.normal(t) for t, in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
            assert not any(i in decontaminate.normal(r["text"]) for r in out.collect() for i in items)
    final = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in final.collect()} == {r[0] for r in out.select("doc_id").collect()}
    assert all(r["exact"] for r in final.collect())


def test_pipeline_rows_without_ids_and_repeated_ids(spark, tmp_path):
    """A doc_id with two texts loses only the copy; rows without doc_id are judged like others."""
    import corpus_pipeline
    rng = random.Random(12)
    own = [" ".join(words(rng, 60)) for _ in range(6)]
    item = " ".join(words(rng, 40, 5000))
    rows = [(1, own[0]), (2, own[0]), (2, own[1]), (None, own[2]), (None, own[2] + " more"), (None, own[3]), (None, None), (None, None), (5, ""),
            (7, own[4]), (7, own[4]), (None, own[4]), (None, item + " " + own[5]), (9, own[5] + " " + item), (9, own[5][:200])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert (1, own[0]) in kept and (2, own[0]) not in kept and (2, own[1]) in kept
    assert sum(t is not None and t.startswith(own[2]) for _, t in kept) == 1 and (None, own[3]) in kept
    assert kept.count((7, own[4])) == 1 and (None, own[4]) not in kept and kept.count((None, None)) == 1 and (5, "") in kept
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(map(str, clean)) == sorted(str(r) for r in rows if item not in (r[1] or ""))
    empty = docs.limit(0)
    assert corpus_pipeline.near_dedup(spark, empty, "").collect() == [] == corpus_pipeline.decontaminated(spark, empty, str(tmp_path)).collect()
