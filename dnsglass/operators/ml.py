"""spark.ml training, inference and evaluation for the binary DGA detector and
the family classifier, plus metric tables computed with DataFrame aggregates.

The reference trains boosted trees / a CNN on one machine; here the same
steps are spark.ml estimators on the labelled table, so training scales with
the cluster.  Model quality numbers of the reference are not claimed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.domain import LEXICAL_KEYS, ENTROPY_KEYS, entropy_feature_list, lexical_feature_list
from ..functions.domain_batch import features as batch_features
from ..schema import BENIGN_FAMILY
from .common import cut_lineage, running_totals
from .ngram import MAX_FEATURES, char_ngrams, ngram_vectors

FEATURE_COLS = LEXICAL_KEYS + ENTROPY_KEYS


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in FEATURE_COLS]))
def _ascii_features(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(batch_features([x or "" for x in names]), columns=FEATURE_COLS)


def domain_feature_columns(df: DataFrame, col: str = "domain") -> DataFrame:
    """Lexical (22) + entropy (4) features as flat double columns.  ASCII names are counted a
    batch at a time; other names (and null) take the column functions, whose character
    classes are Java's."""
    plain = F.col(col).rlike(r"\A[\x00-\x7f]*\z")
    slow = F.struct(*[c.cast("double").alias(k) for k, c in lexical_feature_list(col) + entropy_feature_list(col)])
    with_all = df.withColumn("_fast", _ascii_features(F.when(plain, F.col(col)))).withColumn("_all", F.when(plain, F.col("_fast")).otherwise(slow))
    return with_all.select(*df.columns, *[F.col(f"_all.{k}").alias(k) for k in FEATURE_COLS])


# --- MLP-1 / MLP-3 / MLP-4 -----------------------------------------------------------------

def hash_split(df: DataFrame, col: str = "domain", train_frac: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the domain (the first 32 bits of its md5, with the seed):
    the same rows whenever and wherever the plan runs again, and no domain on both sides."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(col), F.lit(""))))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 < int(train_frac * 10_000)
    return df.where(share), df.where(~share)


def train_binary(df: DataFrame, label: str = "target", max_iter: int = 150, max_depth: int = 10,
                 step_size: float = 0.3, seed: int = 42, col: str = "domain") -> tuple[PipelineModel, DataFrame]:
    """70/30 split by domain hash, standardise, gradient-boosted trees.
    Returns the fitted pipeline and the scored test split."""
    data = cut_lineage(domain_feature_columns(df, col).withColumn("label", F.col(label).cast("double")))  # every step reads them again
    train, test = hash_split(data, col, 0.7, seed)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                      stepSize=step_size, seed=seed),
    ])
    model = pipe.fit(train)
    return model, model.transform(test)


def score_binary(df: DataFrame, model: PipelineModel, col: str = "domain") -> DataFrame:
    """label and probability of the DGA class per domain."""
    out = model.transform(domain_feature_columns(df, col))
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn(
        "label_pred", F.col("prediction").cast("int"))


def cross_validate(df: DataFrame, label: str = "target", folds: int = 5, max_iter: int = 20,
                   max_depth: int = 5, seed: int = 42, col: str = "domain") -> DataFrame:
    """k-fold mean accuracy and F1 of the boosted-tree pipeline."""
    data = domain_feature_columns(df, col).withColumn("label", F.col(label).cast("double"))
    data = cut_lineage(data.select(col, "label", *FEATURE_COLS))  # all folds read them
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features"),
                            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
                            gbt])
    spark = df.sparkSession
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(col)), F.lit(folds))
    totals = {"accuracy": 0.0, "f1": 0.0}
    for k in range(folds):  # each fold is trained once and scored by all metrics
        scored = pipe.fit(data.where(fold != k)).transform(data.where(fold == k)).select("label", "prediction").persist()
        for metric in totals:
            totals[metric] += MulticlassClassificationEvaluator(labelCol="label", metricName=metric).evaluate(scored)
        scored.unpersist()
    return spark.createDataFrame([(m, v / folds) for m, v in totals.items()], "metric string, value double")


# --- MLP-2 / MLP-5 / MLP-6 ------------------------------------------------------------------

#: Character n-grams of the family model and the number of hashed features that they get.
FAMILY_GRAMS = (1, 2, 3)
FAMILY_BUCKETS = 2048


def family_feature_columns(df: DataFrame, col: str = "domain") -> DataFrame:
    """Lexical and entropy features, and the character n-grams as an array; their length
    is a part of them, so a bigram and a trigram never share a name."""
    return with_grams(domain_feature_columns(df, col), col)


def with_grams(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_grams", F.concat(*[char_ngrams(col, n) for n in FAMILY_GRAMS]))


def train_family(df: DataFrame, family: str = "family", col: str = "domain", max_iter: int = 100,
                 seed: int = 42, grams: int = FAMILY_BUCKETS) -> tuple[PipelineModel, DataFrame]:
    """Label-encode the family of DGA rows; sparse character n-gram features (hashed into
    `grams` buckets, IDF, unit length) beside the standardised lexical and entropy ones;
    multinomial logistic regression.  Returns the model and the scored test split."""
    data = with_grams(cut_lineage(domain_feature_columns(df.where(F.col(family) != BENIGN_FAMILY), col)), col)
    train, test = hash_split(data, col, 0.7, seed)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=family, outputCol="label", handleInvalid="keep", stringOrderType="frequencyDesc"),
        VectorAssembler(inputCols=FEATURE_COLS, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True),
        HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=grams),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
        VectorAssembler(inputCols=["scaled_features", "_unit"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter, regParam=1e-4),
    ])
    model = pipe.fit(train)
    return model, model.transform(test)


def family_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def classify_family(df: DataFrame, model: PipelineModel, top_k: int = 3, min_confidence: float = 0.3,
                    only_dga: bool = True, col: str = "domain") -> DataFrame:
    """Top-k (family, confidence) per domain from the probability vector;
    entries under min_confidence dropped; with only_dga, rows whose binary
    label is 0 get an empty list (column `label_pred` when present)."""
    labels = F.array(*[F.lit(x) for x in family_labels(model)])
    out = model.transform(family_feature_columns(df, col)).drop("_grams", "_tf", "_tfidf", "_unit")
    # the indexer's slot for unseen labels, the vector's last, is no family
    probs = F.slice(vector_to_array("probability"), 1, len(family_labels(model)))
    pairs = F.transform(F.arrays_zip(labels.alias("family"), probs.alias("confidence")),
                        lambda z: F.struct((-z["confidence"]).alias("neg"), z["family"].alias("family"),
                                           z["confidence"].alias("confidence")))
    top = F.slice(F.array_sort(pairs), 1, top_k)
    top = F.filter(F.transform(top, lambda s: F.struct(s["family"].alias("family"),
                                                       s["confidence"].alias("confidence"))),
                   lambda s: s["confidence"] >= min_confidence)
    if only_dga and "label_pred" in df.columns:
        top = F.when(F.col("label_pred") == 1, top).otherwise(F.array().cast(top_type()))
    return out.withColumn("top_families", top)


def top_type() -> str:
    return "array<struct<family:string,confidence:double>>"


def score_two_stage(df: DataFrame, binary: PipelineModel, family: PipelineModel, threshold: float = 0.5,
                    weights=(0.6, 0.4), col: str = "domain") -> DataFrame:
    """Binary score; the family model runs only on positives above the
    threshold (filtered, scored, joined back by domain); then the ensemble
    rule (family, weighted score, is_dga)."""
    from .rules import ensemble_score
    b = score_binary(df.select(col).distinct(), binary, col).select(col, "label_pred", "p")
    pos = b.where((F.col("label_pred") == 1) & (F.col("p") >= threshold)).select(col, "label_pred")
    fam = classify_family(pos, family, top_k=1, min_confidence=0.0, only_dga=False, col=col).select(
        col, F.element_at("top_families", 1)["family"].alias("top_family"),
        F.element_at("top_families", 1)["confidence"].alias("top_confidence"))
    j = b.join(fam, col, "left")
    scored = ensemble_score(j, label="label_pred", p="p", family="top_family", conf="top_confidence",
                            threshold=threshold, weights=weights)
    return df.join(scored.select(col, "score", "is_dga", "family", "family_confidence"), col, "left")


# --- MLP-7 / MLP-8 ---------------------------------------------------------------------------

def classification_metrics(pred: DataFrame, truth: str = "truth", predicted: str = "pred") -> DataFrame:
    """Per class: support, tp, fp, fn, precision, recall, F1; plus accuracy."""
    classes = pred.select(F.col(truth).alias("cls")).union(pred.select(F.col(predicted).alias("cls"))).distinct()
    stats = pred.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = stats.where(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("n").alias("tp"))
    sup = stats.groupBy(F.col("t").alias("cls")).agg(F.sum("n").alias("support"))
    prd = stats.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(prd, "cls", "left").na.fill(0)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = j.select(F.col("cls").cast("string").alias("cls"), F.col("support").cast("long").alias("support"),
                   F.col("tp").cast("long").alias("tp"), (F.col("predicted") - F.col("tp")).cast("long").alias("fp"),
                   (F.col("support") - F.col("tp")).cast("long").alias("fn"),
                   prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
    acc = stats.agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("c"),
                    F.sum("n").alias("n"))
    acc = acc.select(F.lit("accuracy").alias("cls"), F.col("n").cast("long").alias("support"),
                     F.col("c").cast("long").alias("tp"), F.lit(None).cast("long").alias("fp"),
                     F.lit(None).cast("long").alias("fn"), (F.col("c") / F.col("n")).alias("precision"),
                     (F.col("c") / F.col("n")).alias("recall"), (F.col("c") / F.col("n")).alias("f1"))
    return per.unionByName(acc)


def confusion_matrix(pred: DataFrame, truth: str = "truth", predicted: str = "pred", classes=(0, 1)) -> DataFrame:
    """A row for each true class, a column for each of the given predicted `classes`."""
    return pred.groupBy(F.col(truth).alias("truth")).pivot(predicted, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def roc_curve(pred: DataFrame, score: str = "prob", truth: str = "truth") -> DataFrame:
    """One ROC point per distinct score (ties grouped), highest score first:
    threshold, tp, fp, tpr, fpr, and `auc_part` whose sum is the AUC."""
    g = pred.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = running_totals(g, "threshold", ["pos", "neg"])
    c = c.withColumn("_one", F.lit(1)).join(F.broadcast(tot.withColumn("_one", F.lit(1))), "_one")
    tpr = F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(0.0)
    fpr = F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).otherwise(0.0)
    part = F.when((F.col("P") > 0) & (F.col("N") > 0),
                  F.col("neg") * (2 * F.col("cum_pos") - F.col("pos")) / (2.0 * F.col("N") * F.col("P"))).otherwise(0.0)
    return c.select("threshold", F.col("cum_pos").cast("long").alias("tp"), F.col("cum_neg").cast("long").alias("fp"),
                    tpr.alias("tpr"), fpr.alias("fpr"), part.alias("auc_part"))


def roc_auc(pred: DataFrame, score: str = "prob", truth: str = "truth") -> DataFrame:
    return roc_curve(pred, score, truth).agg(F.sum("auc_part").alias("auc"))


def binary_auc_spark(pred: DataFrame, score: str = "prob", truth: str = "truth") -> float:
    """spark.ml's evaluator (an action), for cross-checking in tests."""
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=truth, metricName="areaUnderROC")
    return ev.evaluate(pred.withColumn(truth, F.col(truth).cast("double")).withColumn(score, F.col(score).cast("double")))


# --- MLP-9 ---------------------------------------------------------------------------------------

PCA_OVERSAMPLE = 8
PCA_ROUNDS = 12


def pca_ngrams(df: DataFrame, k: int = 2, group: str = "family", col: str = "domain", ns=(1, 2, 3), max_features: int = MAX_FEATURES,
               rounds: int = PCA_ROUNDS, seed: int = 7) -> DataFrame:
    """The first k principal components of the tf-idf n-gram vectors, kept with the group
    label for a scatter by family: group, pc1 .. pck, a row for each row of `df`.

    Randomised block power iteration: with an orthonormal block Q (terms x (k + 8)) each
    round adds up the rows' x (x'Q) and subtracts the mean's share, which is the covariance
    times Q, without the covariance (terms x terms) or dense rows.  Tasks add up their
    rows, Spark adds the tasks' sums by term; the driver holds Q alone, at most
    `max_features` rows for each n.  The largest entry of a component is positive."""
    vectors, terms = ngram_vectors(df.select(col, group), df.select(col), col, ns, max_features)
    vectors = cut_lineage(vectors)
    width = terms.count()
    block = min(k + PCA_OVERSAMPLE, max(width, 1))

    def covariance_times(q: np.ndarray) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, plain, n = np.zeros((width, block)), np.zeros(width), 0
            for batch in it:
                at, idx, val = _sparse(batch)
                row = np.repeat(np.arange(len(batch)), np.diff(at))
                for a, b in _stretches(at):  # of rows: what is made dense stays small
                    r, i, v = row[at[a]:at[b]] - a, idx[at[a]:at[b]], val[at[a]:at[b]]
                    share = _sums(r, v, q[i], b - a)
                    total += _sums(i, v, share[r], width)
                    plain += np.bincount(i, v, width)
                n += len(batch)
            if n:
                rows = np.c_[total, plain, np.full(width, n)]
                yield pa.record_batch([pa.array(np.arange(width)), *(pa.array(c) for c in rows.T)], names=["i", *[f"s{j}" for j in range(block + 2)]])

        sums = vectors.select("indices", "values").mapInArrow(run, "i long, " + ", ".join(f"s{j} double" for j in range(block + 2)))
        got = np.array([list(r) for r in sums.groupBy("i").agg(*[F.sum(f"s{j}") for j in range(block + 2)]).orderBy("i").collect()])
        if not len(got):
            return np.zeros_like(q)
        n = max(got[0, -1], 1)
        mean = got[:, -2] / n
        covariance_times.mean = mean
        return got[:, 1:1 + block] / n - np.outer(mean, mean @ q)

    covariance_times.mean = np.zeros(width)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(covariance_times(q))[0]
    small = q.T @ covariance_times(q)  # the covariance within the block
    values, rotation = np.linalg.eigh((small + small.T) / 2)
    v = (q @ rotation[:, np.argsort(-values)])[:, :k]
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    offset = covariance_times.mean @ v

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at, idx, val = _sparse(batch)
            out = _sums(np.repeat(np.arange(len(batch)), np.diff(at)), val, v[idx], len(batch))
            yield pa.record_batch([batch.column(2), *(pa.array(c) for c in (out - offset).T)], names=[group, *[f"pc{i + 1}" for i in range(v.shape[1])]])

    kind = df.schema[group].dataType.simpleString()
    return vectors.select("indices", "values", group).mapInArrow(project, f"{group} {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(v.shape[1])))


def _stretches(at: np.ndarray, rows: int = 1024) -> Iterator[tuple[int, int]]:
    return ((a, min(a + rows, len(at) - 1)) for a in range(0, len(at) - 1, rows))


def _sums(at: np.ndarray, weight: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Weighted rows added up by the place `at`, a column at a time."""
    return np.column_stack([np.bincount(at, weight * c, size) for c in np.ascontiguousarray(rows.T)]) if rows.shape[1] else np.zeros((size, 0))


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row ends, indices, values) of the sparse rows of a batch (indices, values, ...)."""
    size = np.asarray(pc.fill_null(pc.list_value_length(batch.column(0)), 0))
    return np.r_[0, np.cumsum(size)], np.asarray(batch.column(0).flatten()).astype(np.int64), np.asarray(batch.column(1).flatten())


# --- UDF-3 ------------------------------------------------------------------------------------------

def score_udf(load_model: Callable[[], Callable[[pd.Series], pd.Series]],
              return_type: str = "double") -> Callable[[Column], Column]:
    """Wrap a user model as an iterator pandas UDF: the model is loaded once
    per task and applied to Arrow batches of domains."""
    @F.pandas_udf(return_type)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for b in batches:
            yield model(b)

    return _score
