"""Quality classifier from weak labels (operator 9).

1.  Overlapping heuristic labellers vote reject, keep or abstain on every document:
    repeated neighbours, few different words, runs of symbols, capitals, cell
    separators, a word list of insults, and word stems that go with toxic labels.
    The stems are mined from at most LABELLED labelled documents.
2.  Expectation-maximisation over the counts of the vote patterns of all documents
    (at most 3 ** labellers rows) estimates each labeller's accuracy on good documents
    and on each kind of bad ones, and gives every pattern a posterior probability of
    "reject".  (Bad documents are of one kind each, so one class for all of them would
    make labellers of different kinds contradict each other.)
3.  The posteriors of at most SAMPLE documents (those with the least hash of their
    id) train a linear scorer over hashed features: the words, the word stems, the
    binned style measures and the rejecting votes.  Buckets whose odds do not differ clearly stay at zero.
4.  The scorer alone decides: a document whose score reaches 0.5 is rejected.

Cases: null or empty text and texts under five words get no votes on style; their
one style feature is that they are short.  Without labels there are no stems; without documents the
scorer keeps everything.  Rows are scored one by one, repeated rows alike.  Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import task
from .tables import texts

LABELLED = 20_000
SAMPLE = 8_000
STEM_SIZES = (4, 5)
BUCKETS = 1 << 18
FEATURES = 4_096

KEEP, REJECT, ABSTAIN = 0, 1, 2
# Words of abuse that the lexicon labeller looks for (fixed values).
INSULTS = frozenset("idiot moron loser scum trash clown stupid worthless pathetic disgusting imbecile cretin bastard dumbass jackass scumbag".split())
_letters = re.compile(r"[^\W\d_]+").findall
_SYMBOLS = "!$%&*#"


def style(text: str) -> tuple[int, list[float]]:
    """Number of words, and shares of words: equal to the one before, different, symbols, capitals, separators."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, [0.0, 1.0, 0.0, 0.0, 0.0]
    return n, [sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
               sum(text.count(c) for c in _SYMBOLS) / n, sum(map(str.isupper, words)) / n, text.count("|") / n]


def stems_of(words: set[str]) -> set[str]:
    return {w[:k] for k in STEM_SIZES for w in words if len(w) >= k}


def votes(n: int, shares: list[float], words: set[str], stems: set[str], toxic: frozenset[str]) -> list[int]:
    again, variety, symbols, capitals, cells = shares

    def by(value: float, reject: float, keep: float) -> int:
        return ABSTAIN if n < 5 else REJECT if value > reject else KEEP if value < keep else ABSTAIN

    return [by(again, 0.2, 0.05), by(-variety, -0.2, -0.5) if n >= 30 else ABSTAIN, by(symbols, 0.5, 0.1), by(capitals, 0.5, 0.2), by(cells, 0.2, 0.02),
            REJECT if not INSULTS.isdisjoint(words) else ABSTAIN, REJECT if not toxic.isdisjoint(stems) else ABSTAIN]


#: Labellers of the same kind of bad document overlap.
KINDS = ((0, 1), (2,), (3,), (4,), (5, 6))
LABELLERS = ("neighbours", "variety", "symbols", "capitals", "cells", "insults", "stems")


#: Buckets of the style features: short, then eleven bins of each share.
VOTE = [crc32(b"!%d" % j) for j in range(len(LABELLERS))]
STYLE = [[crc32(b"#short")]] + [[crc32(b"#%d:%d" % (i, b)) for b in range(11)] for i in range(5)]


def features(n: int, shares: list[float], words: set[str], stems: set[str], toxic: frozenset[str]) -> np.ndarray:
    """Hashed features that a document has."""
    keys = [crc32(w.encode()) for w in words]
    keys += [crc32(b"^" + s.encode()) for s in stems]
    keys += STYLE[0] if n < 5 else [STYLE[1 + i][min(10, int(20 * v))] for i, v in enumerate(shares)]
    keys += [VOTE[j] for j, v in enumerate(votes(n, shares, words, stems, toxic)) if v == REJECT]
    return np.unique(np.array(keys, np.int64) % BUCKETS)


def _words(text: str) -> set[str]:
    return set(_letters(text.lower()))


def _least_hashed(rows: DataFrame, n: int) -> DataFrame:
    """The n ids with the least hash, as one row each."""
    return rows.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def toxic_stems(docs: DataFrame, labels: DataFrame) -> frozenset[str]:
    """Stems that go with toxic labels: nearly always toxic, and too often for chance."""
    labelled = labels.select(F.col("doc_id").cast("long"), (F.col("toxic") == 1).cast("int").alias("toxic")).filter("toxic is not null")
    chosen = labelled.join(_least_hashed(labelled, LABELLED), "doc_id").dropDuplicates(["doc_id"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stems = list(stems_of(_words(t or "")))
                yield pa.record_batch([pa.array([*stems, None], pa.string()), pa.array([toxic] * (len(stems) + 1), pa.int32())], names=["stem", "toxic"])

    rows = (texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # LABELLED rows at most
            .mapInArrow(task(run), "stem string, toxic int")
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")))
    total = rows.filter("stem is null").first()
    if total is None or not total["toxic"]:
        return frozenset()
    base = max(total["toxic"] / total["n"], 1e-6)
    least = max(4, int(np.ceil(np.log(1e-9) / np.log(min(base, 0.9)))))
    found = (rows.filter(F.col("stem").isNotNull() & (F.col("toxic") >= least) & (F.col("toxic") >= 0.97 * F.col("n")))
             .select("stem").collect())
    return frozenset(r["stem"] for r in found)


def vote_counts(docs: DataFrame, toxic: frozenset[str]) -> list[tuple[list[int], int]]:
    """The vote patterns of all documents with their counts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                words = _words(text)
                out.append("".join(map(str, votes(*style(text), words, stems_of(words), toxic))))
            yield pa.record_batch([pa.array(out, pa.string())], names=["pattern"])

    rows = texts(docs).mapInArrow(task(run), "pattern string").groupBy("pattern").count().orderBy("pattern").collect()
    return [([int(c) for c in r["pattern"]], r["count"]) for r in rows]


def accuracies(counts: list[tuple[list[int], int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | class) of each labeller, shape (labellers, classes, 3), and P(class); class
    0 is good, the others are the kinds of bad documents."""
    classes = 1 + len(KINDS)
    if not counts:
        return np.full((len(LABELLERS), classes, 3), 1 / 3), np.eye(classes)[0]
    patterns, weight = np.array([p for p, _ in counts]), np.array([c for _, c in counts], float)
    post = np.full((len(patterns), classes), 0.01)
    for k, own in enumerate(KINDS, 1):
        post[:, k] += 10 * (patterns[:, own] == REJECT).any(axis=1)
    post[:, 0] += ~(patterns == REJECT).any(axis=1)
    post /= post.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = post * weight[:, None]
        table = np.stack([((patterns == v)[:, :, None] * share[:, None, :]).sum(axis=0) + 0.1 for v in range(3)], axis=2)
        table /= table.sum(axis=2, keepdims=True)
        prior = (share.sum(axis=0) + 0.1) / (weight.sum() + 0.1 * classes)
        new = classes_of(patterns, table, prior)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return table, prior


def classes_of(patterns: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(class | votes), one row for each pattern.  A document is of a bad kind only if
    one of the kind's labellers rejects it."""
    logs = np.log(np.maximum(table, 1e-12))
    total = np.log(np.maximum(prior, 1e-12)) + sum(logs[j, :, patterns[:, j]] for j in range(patterns.shape[1]))
    for k, own in enumerate(KINDS, 1):
        total[~(patterns[:, own] == REJECT).any(axis=1), k] = -np.inf
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(reject | votes)."""
    return 1 - classes_of(patterns, table, prior)[:, 0]


def train(rows: list[np.ndarray], target: np.ndarray, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias: logistic regression on soft labels over the
    buckets whose odds differ clearly."""
    weights = np.zeros(BUCKETS)
    total = float(target.sum())
    if not len(rows) or total < 1e-3:
        return weights, -4.0
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bad = np.bincount(flat, target[row], BUCKETS)
    n = np.bincount(flat, minlength=BUCKETS)
    base = total / len(rows)
    z = (bad - n * base) / np.sqrt(n * base * (1 - base) + 1e-9)
    chosen = np.flatnonzero((n >= 3) & (np.abs(z) > 5))
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[:FEATURES]]
    chosen = np.union1d(chosen, np.concatenate([*STYLE, VOTE]) % BUCKETS)
    slot = np.full(BUCKETS, -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[flat] >= 0
    col, row = slot[flat[keep]], row[keep]
    w, b = np.zeros(len(chosen)), float(np.log(base / (1 - base)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):  # Adam
        p = 1 / (1 + np.exp(-(np.bincount(row, w[col], len(rows)) + b)))
        g = np.append(np.bincount(col, (p - target)[row], len(chosen)) / len(rows) + 0.02 / len(rows) * w, (p - target).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w
    return weights, float(b)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, table: np.ndarray, prior: np.ndarray, stems: frozenset[str]):
        self.weights, self.bias, self.table, self.prior, self.stems = weights, bias, table, prior, stems

    def score(self, text: str | None) -> float:
        words = _words(text or "")
        total = self.bias + self.weights[features(*style(text or ""), words, stems_of(words), self.stems)].sum()
        return float(1 / (1 + np.exp(-total)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    toxic = toxic_stems(docs, labels)
    table, prior = accuracies(vote_counts(docs, toxic))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, shape = _words(t or ""), style(t or "")
                stems = stems_of(words)
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([votes(*shape, words, stems, toxic)], pa.list_(pa.int32())),
                                       pa.array([features(*shape, words, stems, toxic)], pa.list_(pa.int32()))], names=["doc_id", "votes", "features"])

    sample = (texts(docs).join(F.broadcast(_least_hashed(docs.select(F.col("doc_id").cast("long")), SAMPLE)), "doc_id").select("doc_id", "text")
              .mapInArrow(task(run), "doc_id long, votes array<int>, features array<int>").toLocalIterator())  # SAMPLE ids at most
    seen: dict[int, tuple[list[int], np.ndarray]] = {}
    for r in sample:
        seen.setdefault(r["doc_id"], (list(r["votes"]), np.array(r["features"], np.int64)))
    order = sorted(seen)
    target = posterior(np.array([seen[i][0] for i in order]), table, prior) if order else np.zeros(0)
    weights, bias = train([seen[i][1] for i in order], target)
    return Model(weights, bias, table, prior, toxic)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (probability of "reject"), kept for every row of `docs`."""
    model = fit(docs, labels)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = np.array([model.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.record_batch([batch.column(0), pa.array(s), pa.array(s < 0.5)], names=["doc_id", "score", "kept"])

    return texts(docs).mapInArrow(task(run), "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array([model.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(task(run), docs.schema)
