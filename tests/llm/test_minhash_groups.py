"""Verification of large MinHash groups: no link lost between parts, texts in proportion."""

import random

from dnsglass.llm import minhash


def _words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def _brute(texts):
    """Least member of each component by comparing all pairs of five-word shingle sets."""
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    least = {d: d for d in sets}
    while True:
        new = {d: min(least[e] for e in sets if len(sets[d] & sets[e]) * 100 >= 75 * len(sets[d] | sets[e])) for d in sets}
        if new == least:
            return least
        least = new


def _chain(rng, first, n, size=60):
    """Texts of which each is linked with its neighbours only."""
    now, out = _words(rng, size), []
    for i in range(n):
        out.append((first + i, " ".join(now)))
        now = list(now)
        now[(7 * i) % size] = f"new{first + i}"
    return out


def test_no_link_is_lost_between_parts(spark):
    rng = random.Random(4)
    rows = [(0, " ".join(_words(rng, 40)))]  # a lead that is linked with nothing
    rows += _chain(rng, 1, 25) + _chain(rng, 40, 25) + [(80 + i, " ".join(_words(rng, 30))) for i in range(8)]
    base = _words(rng, 50)
    rows += [(100 + i, " ".join([*base, f"tail{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(d, 0) for d, _ in rows if d], "doc long, lead long")
    want = _brute(rows)
    for part, block in ((4, 3), (7, 100), (100, 5)):
        got = {r["node"]: r["component"] for r in minhash.linked(pairs, docs, part=part, block=block).collect()}
        assert {d: got.get(d, d) for d, _ in rows} == want
    got = minhash.near_duplicates(docs, part=4, block=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_texts_of_a_large_group_travel_in_proportion(spark):
    for n in (1_000, 6_000):
        pairs = spark.createDataFrame([(i, 0) for i in range(1, n)], "doc long, lead long")
        whole = spark.createDataFrame([(i, 0) for i in range(n)], "node long, component long")
        assert minhash.left_apart(pairs, whole).collect() == []  # one component: nothing left to compare
        apart = spark.createDataFrame([(i, 0) for i in range(n - 100)], "node long, component long")
        rows = minhash.left_apart(pairs, apart)
        # the 100 others meet each block of the largest component, whose texts travel once
        assert rows.filter("label = 0").count() == n - 101
        assert rows.filter("label <> 0").count() == 100 * (1 + -(-(n - 101) // minhash.BLOCK))
