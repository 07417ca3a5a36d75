"""Passage dedup, periodic runs and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsglass.llm import collocations, passage_dedup, periodic, queries_words

SCHEMA = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, parts=4):
    return (spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("doc", F.lit("clash")).withColumn("copy", F.lit(1))
            .withColumn("block", F.lit("x")).withColumn("n", F.lit(2.5)))


# --- 11 -------------------------------------------------------------------------

def brute_passages(rows, length):
    least = {}
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - length + 1):
            k = tuple(w[p:p + length])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            if least[tuple(w[p:p + length])] < d:
                gone[p:p + length] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), kept))
    return sorted(out)


def passage_rows(rng):
    def own(n):
        return [f"{rng.choice('bcdé')}{rng.randint(0, 900)}" for _ in range(n)]

    shared = [own(n) for n in (50, 51, 55, 60, 71, 120, 49)]
    rows = []
    for i in range(150):
        w = own(rng.choice([0, 3, 20, 49, 50, 51, 80, 200]))
        kind = i % 6
        if kind in (1, 2):
            for s in rng.sample(shared, rng.randint(1, 3)):
                k = rng.randint(0, len(w))
                cut = rng.randint(0, 6) if kind == 2 else 0
                w = w[:k] + s[cut:] + w[k:]
        elif kind == 3 and rows:
            w = rng.choice(rows)[1].split()
        elif kind == 4 and rows:
            w = rng.choice(rows)[1].split()
            for _ in range(len(w) // 60):
                w[rng.randrange(len(w))] = "edited"
        elif kind == 5:
            w = w + w[-70:] + own(4) + w[-70:]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t"]).join(w), "en"))
    return rows


def test_cover():
    assert passage_dedup.is_cover(passage_dedup.COVER, passage_dedup.PERIOD)
    assert not passage_dedup.is_cover((0, 1, 4), 21)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    rows = passage_rows(random.Random(seed))
    rows += [(-5, rows[3][1] + " " + rows[7][1], "en"), (2_000_000, None, None), (2_000_001, "", "x"), (2_000_002, " \n", "x")]
    got = passage_dedup.without_passages(frame(spark, rows))
    assert sorted(tuple(r[:4]) for r in got.collect()) == brute_passages(rows, 50)
    for r in got.collect():
        assert sum(x.words for x in r.removed) == r.n_removed


def test_passages_of_other_lengths_and_small_alphabets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(0, 90))), "en") for i in range(60)]
    got = passage_dedup.without_passages(frame(spark, rows), length=9, period=7, cover=(1, 2, 4))
    assert sorted(tuple(r[:4]) for r in got.collect()) == brute_passages(rows, 9)
    rows = [(1, "a " * 300, "en"), (2, "a " * 200 + "b " + "a " * 30, "en"), (3, "b " + "a " * 70, "en")]
    got = passage_dedup.without_passages(frame(spark, rows))
    assert sorted(tuple(r[:4]) for r in got.collect()) == brute_passages(rows, 50)
    with pytest.raises(ValueError):
        passage_dedup.without_passages(frame(spark, rows), cover=(0, 1))


def test_passages_hot_group_over_many_partitions(spark):
    """A passage with other surroundings in every document, some of them copies."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(64)]
    rows = []
    for i in range(600):
        before, after = ([f"{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))] for _ in range(2))
        rows.append((i, " ".join(before + passage + after), "en"))
        if i % 5 == 0:
            rows.append((10_000 + i, rows[-1][1], "en"))
    got = passage_dedup.without_passages(frame(spark, rows, 40))
    assert sorted(tuple(r[:4]) for r in got.collect()) == brute_passages(rows, 50)


def test_passages_without_ids_and_repeated_rows(spark):
    w = " ".join(f"w{i}" for i in range(60))
    got = passage_dedup.without_passages(frame(spark, [(None, w, "en"), (None, w + " x", "en"), (4, w + " y", "en"), (4, w + " z", "en"), (5, w, "en"), (5, w, "en")]))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in got.collect()) == [
        (-1, 60, 0, w), (-1, 61, 0, w + " x"), (4, 61, 60, "y"), (4, 61, 60, "z"), (5, 60, 60, ""), (5, 60, 60, "")]
    assert passage_dedup.without_passages(frame(spark, [])).collect() == []


# --- 12 -------------------------------------------------------------------------

def brute_runs(w, exponent=4, shortest=6):
    found, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        s = 0
        while s < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(shortest, exponent * q):
                found.setdefault((s, e - s + q), q)
            s = e + 1 if e == s else e + 1
    out = []
    for (s, n_), q in found.items():  # smallest period: none smaller has the same stretch
        out.append((s, n_, q))
    return sorted(x for x in out if not any(p < x[2] and all(w[i] == w[i + p] for i in range(x[0], x[0] + x[1] - p)) for p in range(1, x[2])))


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            w = w[:20] + (unit * 12)[:rng.randint(1, 50)] + w[20:]
        assert periodic.runs_of(w) == brute_runs(w), w
        assert periodic.runs_of(w, 5, 12) == brute_runs(w, 5, 12), w


def test_squares_are_reported_by_last_occurrence():
    a = periodic.SuffixAutomaton(2)
    assert [a.append(x) for x in (0, 0, 1, 0, 1)] == [[], [(1, 1)], [], [], [(2, 2)]]
    b = periodic.SuffixAutomaton(3)
    seen = [b.append(x) for x in [0, 1, 2, 0, 1, 2, 0]]
    assert (3, 3) in seen[5] and (3, 4) in seen[6]


def test_candidate_stretches_lose_no_run():
    rng = random.Random(8)
    for _ in range(300):
        rows, flat = [], []
        for r in range(3):
            w = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.5:
                w += [9, 8, 7][:rng.randint(1, 3)] * rng.randint(4, 7) + [rng.randrange(6) for _ in range(5)]
            rows.append(w)
            flat += [(x, r) for x in w]
        words = np.array([x * 7919 + 13 for x, _ in flat], np.uint64)
        row = np.array([r for _, r in flat], np.int64)
        base = np.cumsum([0] + [len(w) for w in rows])
        s, e = periodic.candidate_stretches(words, row)
        for r, w in enumerate(rows):
            for x, n, _ in brute_runs(w):
                assert any(a <= base[r] + x and base[r] + x + n <= b for a, b in zip(s, e))


def expected_op12(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    names = {}
    runs = brute_runs([names.setdefault(x, len(names)) for x in w])
    gone = set()
    for s, m, q in runs:
        gone |= set(range(s + q, s + m))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op12_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w = [f"ä{rng.randint(0, 40)}" for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 90]))]
        if i % 7 == 0:
            w += ["na"] * rng.randint(3, 9) + ["x"] + ["a", "b", "c"] * rng.randint(2, 6)
        rows.append((i, rng.choice([" ", "\n\t"]).join(w), "en"))
    rows += [(1000, None, "en"), (1001, "", None), (1002, " \v", None), (None, "a " * 9, "en"), (1003, "a " * 9, "en"), (1003, "a " * 9, "en")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries_words.op12_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=order) == sorted((expected_op12(d, t) for d, t, _ in rows), key=order)


def test_periodic_runs_long_text_and_empty_table(spark):
    text = " ".join(["z"] + [f"k{i % 500}" for i in range(30_000)] + ["y"])
    (r,) = periodic.periodic_runs(frame(spark, [(1, text, "en")])).collect()
    assert [tuple(x) for x in r.runs] == [(1, 30_000, 500)]
    assert len(r.kept.split()) == 502 and r.n_words == 30_002
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


# --- 13 -------------------------------------------------------------------------

def brute_collocations(rows, least, top, longest=4):
    n, f = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(q[i:i + len(p)] == p and b >= least and 100 * b >= 80 * a
                     for (m, q), b in f.items() if m == lang and len(q) > len(p) and b >= least for i in range(len(q) - len(p) + 1))
        if not inside:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    got = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        got += [(x[0], i, *x[1:]) for i, x in enumerate(mine, 1)]
    return sorted(got)


def phrase_rows(rng):
    words = [f"{c}{i}" for c in "aBé" for i in range(6)] + ["new york", "𝒳"]
    rows = []
    for i in range(120):
        t = []
        for _ in range(rng.randint(0, 25)):
            t.append(" ".join(rng.choices(words, k=rng.randint(0, 6))) if rng.random() < 0.7 else rng.choice(["Point of view", "as far as I", "at the end of the day", "of view"]))
        rows.append((i, rng.choice([". ", ",", "\n", " \t"]).join(t), rng.choice(["en", "de", None])))
    return rows + [(500, None, "en"), (501, "", "xx"), (502, "a a a a a a a a", "und"), (502, "a a a a a a a a", "und"), (503, "x " * 5000, "fr")]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_collocations_equal_brute_force(spark, block):
    rows = phrase_rows(random.Random(2))
    got = collocations.collocations(frame(spark, rows), least=5, top=40, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 5, 40)


def test_collocations_contract_query(spark, tmp_path):
    rows = phrase_rows(random.Random(3))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries_words.op13_collocations(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 30, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, " ,", "en"), (3, "one two", "en")])).collect() == []
