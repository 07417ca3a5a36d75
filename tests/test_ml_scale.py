"""Features by batches, and training steps that read their features once."""

import random

import numpy as np
import pytest

from dnsglass.functions import domain as D
from dnsglass.operators import ml as ML


def _names():
    rnd = random.Random(5)
    odd = ["", ".", "..", "a", "a.b", ".a.b", "a..b", "a.b.", "x_y--9.Co.uk", "UPPER.Case.ORG", "täst.de", "a.٣٤.com", "日本.jp", "a\nb.c", "9" * 70 + ".com", " a b.c d "]
    return odd + ["".join(rnd.choice("abcdeiouxyzAEZ0123456789-_. ") for _ in range(rnd.randint(0, 40))) for _ in range(300)]


def test_batch_features_are_the_column_functions(spark):
    df = spark.createDataFrame([(n,) for n in _names()] + [(None,)], "domain string")
    want = df.select("domain", D.lexical_features("domain").alias("l"), D.entropy_features("domain").alias("e")).select("domain", "l.*", "e.*")
    key = lambda r: r["domain"] or "none"
    for a, b in zip(sorted(ML.domain_feature_columns(df).collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert {k: v for k, v in a.asDict().items() if v is None} == {k: v for k, v in b.asDict().items() if v is None}
        assert {k: v for k, v in a.asDict().items() if v is not None} == pytest.approx({k: v for k, v in b.asDict().items() if v is not None}, abs=1e-12)


def _counted(spark):
    """Labelled rows that count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r
    rnd = random.Random(1)
    rows = [(f"{''.join(rnd.choice('abcdefgh123') for _ in range(9))}-{i}.com", i % 2, "alexa" if i % 2 == 0 else f"f{i % 3}") for i in range(200)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(seen), "domain string, target int, family string"), made


def test_binary_training_reads_its_rows_once(spark):
    df, made = _counted(spark)
    _, scored = ML.train_binary(df, max_iter=2, max_depth=2)
    assert scored.count() > 0
    assert made.value == 200


def test_family_training_reads_its_rows_once(spark):
    df, made = _counted(spark)
    _, scored = ML.train_family(df, max_iter=2)
    assert scored.count() > 0
    assert made.value == 200


def test_all_folds_read_the_rows_once(spark):
    df, made = _counted(spark)
    assert ML.cross_validate(df, folds=3, max_iter=2, max_depth=2).count() == 2
    assert made.value == 200


def test_sums_of_sparse_rows():
    rng = np.random.default_rng(1)
    at, weight, rows = rng.integers(0, 5, 40), rng.random(40), rng.random((40, 3))
    want = np.zeros((7, 3))
    np.add.at(want, at, weight[:, None] * rows)
    assert ML._sums(at, weight, rows, 7) == pytest.approx(want)
    assert list(ML._stretches(np.arange(6), 2)) == [(0, 2), (2, 4), (4, 5)]
