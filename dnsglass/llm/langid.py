"""Language identification by nearest centroid (operator 2).

A text's vector holds its letter n-grams (1 to 3 characters, lower case, anything
that is no letter is a blank), hashed to DIMS, as sqrt(count) * idf, normalised to
length 1.  Document frequencies are counted over all training rows.  The training
vectors of each language, at most PER_LANGUAGE rows (those with the least hash of
their id), are clustered into CLUSTERS centroids by spherical k-means.  A text gets
the language of the centroid with the largest cosine.  Distance-based rejection:
each centroid has a radius, the cosine that all but RADIUS of its members reach,
less MARGIN; a text outside the radius of its nearest centroid is `far`, and
`predict(reject=True)` answers `und` for it.

Cases: null text or no letter -> `und`, score 0.  Equal cosines: the first language
by name.  No training rows -> `und` for all.  Rows without doc_id are predicted but
never learned from.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import U64

DIMS = 4096
PER_LANGUAGE = 400
CLUSTERS = 4
RADIUS, MARGIN = 0.01, 0.1
_CHUNK = 300_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts, one row of DIMS for each text, and which texts have letters."""
    chars = [np.frombuffer(("  " + t.lower() + "  ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    size = np.array([len(c) for c in chars])
    flat = np.concatenate(chars)
    letter = _letters()[flat]
    flat = np.where(letter, flat, 32).astype(U64)
    row = np.repeat(np.arange(len(texts)), size)
    has = np.bincount(row, letter, len(texts)) > 0
    out = np.zeros(len(texts) * DIMS)
    gram, any_letter = np.zeros(len(flat), U64), np.zeros(len(flat), bool)
    for n in range(3):  # a gram that crosses a text's end is all blanks there
        gram = gram[:len(flat) - n] * U64(0x9E3779B97F4A7C15) + flat[n:] + U64(n + 1)
        any_letter = any_letter[:len(flat) - n] | letter[n:]
        at = np.flatnonzero(any_letter)
        slot = ((gram[at] * U64(0xD6E8FEB86659FD93)) >> U64(52)).astype(np.int64)
        out += np.bincount(row[at] * DIMS + slot, minlength=len(out))
    return out.reshape(len(texts), DIMS), has


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts, has letters) for parts of a text column."""
    a, total, held = 0, 0, []
    for i, t in enumerate(column):
        held.append(t.as_py() or "")
        total += len(held[-1])
        if total >= _CHUNK or len(held) >= 200:
            yield a, *counts(held)
            a, total, held = i + 1, 0, []
    if held:
        yield a, *counts(held)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(n) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def cluster(x: np.ndarray, k: int = CLUSTERS, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and their radii by spherical k-means, begun at far-apart rows."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cos = x @ c.T
    own = cos.argmax(axis=1)
    radius = np.array([np.quantile(cos[own == i, i], RADIUS) - MARGIN if (own == i).any() else 1.0 for i in range(len(c))])
    return c, radius


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, radius: np.ndarray):
        self.idf, self.langs, self.centroids, self.radius = idf, langs, centroids, radius

    def nearest(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, far) for rows of counts."""
        cos = vectors(n, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)  # the first of equals; centroids are in order of language
        top = cos[np.arange(len(best)), best]
        return best, top, top < self.radius[best]


def fit(docs: DataFrame) -> Model | None:
    """Learns from rows with text, lang and doc_id that are not held out."""
    train = _columns(docs).filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(DIMS, np.int64), 0
        for batch in it:
            for _, n, _ in _parts(batch.column(0)):
                df += (n > 0).sum(axis=0)
                rows += len(n)
        yield pa.record_batch([pa.array(np.arange(-1, DIMS)), pa.array(np.r_[rows, df])], names=["slot", "n"])

    found = {r["slot"]: r["n"] for r in train.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    if not found.get(-1):
        return None
    idf = np.log((1 + found[-1]) / (1 + np.array([found.get(i, 0) for i in range(DIMS)]))) + 0.1

    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = (train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("rank", F.row_number().over(by_hash))
              .filter(F.col("rank") <= PER_LANGUAGE).select("doc_id", F.col("lang").alias("sampled")))
    rows = train.join(chosen, (train.doc_id == chosen.doc_id) & (train.lang == chosen.sampled), "left_semi").select("lang", "text")

    def centroids(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # PER_LANGUAGE rows, and repeats of them
        x = []
        for _, n, has in _parts(pa.array(sorted(set(pdf["text"]))[:PER_LANGUAGE], pa.string())):
            x.append(vectors(n[has], idf))
        x = np.concatenate(x)
        if not len(x):
            return pd.DataFrame({"lang": [], "radius": [], "c": []})
        c, radius = cluster(x)
        return pd.DataFrame({"lang": key[0], "radius": radius, "c": list(c)})

    made = rows.groupBy("lang").applyInPandas(centroids, "lang string, radius double, c array<double>").collect()  # CLUSTERS rows a language
    if not made:
        return None
    made.sort(key=lambda r: (r["lang"], r["c"]))
    return Model(idf, [r["lang"] for r in made], np.array([r["c"] for r in made]), np.array([r["radius"] for r in made]))


def predict(docs: DataFrame, model: Model | None, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine), far for every row of `docs`."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lang: list[str] = []
            score: list[float] = []
            beyond: list[bool] = []
            for _, n, has in _parts(batch.column(2)):
                if model is None:
                    has = np.zeros(len(n), bool)
                    best, top, far = np.zeros(len(n), int), np.zeros(len(n)), ~has
                else:
                    best, top, far = model.nearest(n)
                lang += [model.langs[b] if h and not (reject and f) else "und" for b, h, f in zip(best.tolist(), has.tolist(), far.tolist())]
                score += np.where(has, np.clip(top, 0, 1), 0.0).tolist()
                beyond += (far | ~has).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(beyond, pa.bool_())],
                                  names=["doc_id", "held_out", "lang_pred", "score", "far"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, far boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
