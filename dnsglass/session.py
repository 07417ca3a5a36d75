"""Spark session helpers.

The library never creates a session inside an operator; callers hand one in.
`get_session` is the convenience used by tests, bench and the CLI.  On a cluster
the session is built by the platform and these settings come from its config.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a 1000-executor deployment keeps as well: AQE re-plans joins and
# coalesces / splits shuffle partitions at runtime; skew-join splits hot keys.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Broadcast is decided by statistics with this cap; explicit hints in the
    # library are only placed on sides whose size is bounded by construction.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "dnsglass", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("DNSGLASS_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("DNSGLASS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by `spark.checkpoint.dir`.

    On a cluster that setting names a shared (HDFS / object store) folder and is
    used as is; without it there is no folder that all executors see, so that is
    an error.  Only a local master gets a scratch folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="dnsglass-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` holds anything, asked of Spark's file system for it; a failed
    look-up is an error, never "no"."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not f.getPath().getName().startswith((".", "_")) for f in fs.listStatus(p))
