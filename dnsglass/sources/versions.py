"""Small tables with versions: a folder for each version and a pointer to the current one.

A version is written whole before a row of the pointer names it, so that readers see the
old rows or the new ones.  Versions only grow; the writer's `token` makes a retried write
a no-op.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists


def _pointer(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, token) of the published versions, oldest first; the table keeps a row for each."""
    if not path_exists(spark, f"{path}/current"):
        return []
    rows = spark.read.schema("version long, token string").json(f"{path}/current").distinct().orderBy("version").collect()
    return [(r["version"], r["token"]) for r in rows]


def current_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of the newest published version, or of a given one; None without it."""
    known = [v for v, _ in _pointer(spark, path)]
    version = version if version is not None else max(known, default=None)
    if version not in known or not path_exists(spark, f"{path}/v{version}"):
        return None
    return spark.read.parquet(f"{path}/v{version}")


def next_version(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], token: str, keep: int = 10) -> int:
    """Publishes make(rows of the current version) as the next version and returns its number;
    for a token that was published before, just its number.  Folders of versions older
    than the newest `keep` are removed.  One writer at a time."""
    known = _pointer(spark, path)
    for version, made_by in known:
        if made_by == token:
            return version
    version = max((v for v, _ in known), default=0) + 1
    # a folder left by a write that failed before it was published is replaced
    make(current_version(spark, path)).write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.createDataFrame([(version, token)], "version long, token string").coalesce(1).write.mode("append").json(f"{path}/current")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for old, _ in known:
        gone = fs_path(f"{path}/v{old}")
        fs = gone.getFileSystem(spark._jsc.hadoopConfiguration())
        if old <= version - keep and fs.exists(gone):
            fs.delete(gone, True)
    return version
