"""The event store: a table of events with versions, kept as delta files and a manifest.

Layout below the store's path:
* `data/v=<n>/<index>=<value>/`: the rows that write n brought, one per event_id;
* `manifest/`: a JSON row for each version: its number, the data folders that make it up
  (oldest first) and the writer's token.

A write touches no stored file: it adds a data folder, then one manifest row, which is a
single file that appears whole or not at all.  What a failed write leaves behind is
named by no row; the next write replaces it.  Reading merges the folders by event_id, the
newest first; `compact_event_store` merges them on disk, `vacuum_event_store` removes
folders that the newest versions do not use.  One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

_MANIFEST = "version long, parts array<long>, token string, index string"


def _versions(spark: SparkSession, path: str) -> list:
    """The manifest's rows, oldest first."""
    if not path_exists(spark, f"{path}/manifest"):
        return []
    return sorted(spark.read.schema(_MANIFEST).json(f"{path}/manifest").collect(), key=lambda r: r["version"])


def is_event_store(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/manifest")


def has_batch(spark: SparkSession, path: str, token: str) -> bool:
    """Whether a write with this token was published."""
    return any(r["token"] == token for r in _versions(spark, path))


def _commit(spark: SparkSession, path: str, version: int, parts: list[int], token: str, index: str) -> None:
    spark.createDataFrame([(version, parts, token, index)], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _folder(path: str, part: int) -> str:
    return f"{path}/data/v={part}"


def _orderable(df: DataFrame, name: str) -> Column:
    """The column, or for a map its sorted entries, so that rows have one order."""
    return F.array_sort(F.map_entries(name)) if dict(df.dtypes)[name].startswith("map") else F.col(name)


def one_per_event(df: DataFrame) -> DataFrame:
    """One row per event_id: the latest (ts), then the largest by its other columns, maps
    included, so that equal inputs give equal stores."""
    rest = [c for c in df.columns if c != "event_id"]
    order = F.struct("ts", *[_orderable(df, c) for c in rest if c != "ts"])
    best = df.groupBy("event_id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select("event_id", "r.*").select(df.columns)


def append_events(df: DataFrame, path: str, index: str = "event_date", files: int = 8, token: str | None = None) -> int:
    """Writes the rows as a delta partitioned by the column `index` and publishes the next
    version; its number.  A token that was published before is not written again.
    Columns of other types than the store's, or another index, are an error, and the
    store stays as it is."""
    spark = df.sparkSession
    known = _versions(spark, path)
    token = token or uuid.uuid4().hex
    for row in known:
        if row["token"] == token:
            return row["version"]
    if known:
        if known[-1]["index"] != index:
            raise ValueError(f"the store is kept by {known[-1]['index']}, not by {index}")
        kinds = dict(_read_parts(spark, path, known[-1]["parts"]).dtypes)
        wrong = [f"{c}: {kinds[c]} stored, {t} new" for c, t in df.dtypes if c in kinds and kinds[c] != t and c != index]
        if wrong:
            raise ValueError("column types differ from the store's: " + "; ".join(wrong))
    version = known[-1]["version"] + 1 if known else 1
    rows = one_per_event(df)
    (rows.repartition(index, F.pmod(F.xxhash64("event_id"), F.lit(files))).write.mode("overwrite").partitionBy(index).parquet(_folder(path, version)))
    _commit(spark, path, version, [*(known[-1]["parts"] if known else []), version], token, index)
    return version


def _read_parts(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    frames = [spark.read.parquet(_folder(path, p)).withColumn("_part", F.lit(p)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_event_store(spark: SparkSession, path: str, predicate: Column | None = None, version: int | None = None) -> DataFrame:
    """The events of the newest version, or of a given one, that meet `predicate`.

    The oldest folder holds one row per event, so only the deltas are grouped; its rows are
    kept unless a delta has their id.  The predicate reaches that folder's scan (index
    partitions are pruned) and is applied to the deltas after their merge, because a
    newer row of an event may lie in another partition."""
    row = next((r for r in reversed(_versions(spark, path)) if version in (None, r["version"])), None)
    if row is None:
        raise ValueError(f"no version {version if version is not None else ''} of an event store at {path}")
    keep = predicate if predicate is not None else F.lit(True)
    base = spark.read.parquet(_folder(path, row["parts"][0]))
    if len(row["parts"]) == 1:
        return base.where(keep)
    deltas = _read_parts(spark, path, row["parts"][1:])
    rest = [c for c in deltas.columns if c not in ("event_id", "_part")]
    newest = deltas.groupBy("event_id").agg(F.max_by(F.struct(*rest), "_part").alias("r")).select("event_id", "r.*")
    old = base.where(keep).join(deltas.select("event_id"), "event_id", "left_anti")
    return old.unionByName(newest.where(keep), allowMissingColumns=True)


def compact_event_store(spark: SparkSession, path: str, files: int = 8) -> int:
    """Publishes a version with the same rows in one folder."""
    known = _versions(spark, path)
    last = known[-1]
    if len(last["parts"]) == 1:
        return last["version"]
    version = last["version"] + 1
    rows = read_event_store(spark, path)
    (rows.repartition(last["index"], F.pmod(F.xxhash64("event_id"), F.lit(files))).write.mode("overwrite").partitionBy(last["index"]).parquet(_folder(path, version)))
    _commit(spark, path, version, [version], uuid.uuid4().hex, last["index"])
    return version


def vacuum_event_store(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Removes the data folders that none of the newest `keep` versions uses; their numbers."""
    known = _versions(spark, path)
    used = {p for r in known[-keep:] for p in r["parts"]}
    gone = sorted({p for r in known for p in r["parts"]} - used)
    for p in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, p))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
