"""Batch and stream readers (SRC-1 .. SRC-11).

Every reader returns a lazy DataFrame with an explicit schema where the
format allows one, so no inference pass runs on hot paths, and file
provenance comes from the `_metadata` column, not from a driver-side listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import conj
from ..schema import DNS_MESSAGE_SCHEMA
from .store import is_event_store, read_event_store

LABELLED_SCHEMA = T.StructType([T.StructField("Domain", T.StringType()), T.StructField("Target", T.IntegerType()),
                                T.StructField("Botnet_Family", T.StringType())])


def _lines(df: DataFrame) -> DataFrame:
    """Trim, drop blank lines, tag lines that hold a JSON object."""
    line = F.trim(F.col("value"))
    out = df.select(line.alias("raw"), F.col("_metadata.file_path").alias("file_path")).where(F.col("raw") != "")
    return out.withColumn("is_json", F.coalesce(F.get_json_object("raw", "$").isNotNull()
                                                & F.col("raw").startswith("{"), F.lit(False)))


def read_log_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """SRC-1: one row per non-blank trimmed line; `is_json` when it is a JSON object."""
    rd = spark.read.format("text")
    if encoding.lower().replace("-", "") != "utf8":
        rd = rd.option("encoding", encoding)
    return _lines(rd.load(path))


def read_log_dir(spark: SparkSession, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """SRC-2: all files matching a glob (optionally recursive)."""
    rd = spark.read.format("text").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return _lines(rd.load(path))


def file_counters(lines: DataFrame) -> DataFrame:
    """Per-file and rolled-up line counters of a directory read."""
    per = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"))
    return per.rollup("file_path").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"))


def read_dns_stream(spark: SparkSession, fmt: str = "json", path: str | None = None, options: dict | None = None,
                    schema: T.StructType = DNS_MESSAGE_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-3 / SRC-6: unbounded DNS messages.  `fmt='kafka'` reads topic
    records (value as `raw`); file formats watch `path` for new files."""
    rs = spark.readStream
    if fmt == "kafka":
        opts = {"subscribe": "dns-query-logs", "startingOffsets": "latest"}
        opts.update(options or {})
        df = rs.format("kafka").options(**opts).load()
        return df.select(F.col("value").cast("string").alias("raw"), F.col("topic"), F.col("partition"),
                         F.col("offset"), F.col("timestamp").alias("ingest_ts"))
    rs = rs.options(**(options or {}))
    if max_files_per_trigger:
        rs = rs.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "text":
        return rs.format("text").load(path).select(F.trim("value").alias("raw")).where(F.col("raw") != "")
    df = rs.format(fmt).schema(schema).load(path)
    return df.select(F.to_json(F.struct(*df.columns)).alias("raw"), *df.columns)


def watch_dir(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
              max_files_per_trigger: int = 100) -> DataFrame:
    """SRC-6: keep listening for new files in a directory."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .load(path).withColumn("file_path", F.col("_metadata.file_path")))


def tag_source(df: DataFrame, source: str, topic: str | None = None, file_path: str | None = None) -> DataFrame:
    """SRC-4: metadata injection."""
    out = df.withColumn("source", F.lit(source))
    if topic is not None:
        out = out.withColumn("topic", F.lit(topic))
    if file_path is not None:
        out = out.withColumn("file_path", F.lit(file_path))
    return out


def read_records(spark: SparkSession, path: str, fmt: str = "jsonl", schema: T.StructType | None = None,
                 encoding: str = "utf-8", recursive: bool = False, options: dict | None = None) -> DataFrame:
    """SRC-5: jsonl / json / csv / parquet with encoding and recursive scan."""
    rd = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema is not None:
        rd = rd.schema(schema)
    if fmt in ("jsonl", "json"):
        rd = rd.option("encoding", encoding).option("multiLine", str(fmt == "json").lower())
        fmt = "json"
    elif fmt == "csv":
        rd = rd.option("header", "true").option("encoding", encoding)
    return rd.options(**(options or {})).format(fmt).load(path)


def read_events(spark: SparkSession, base: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """SRC-7: the events of the store at `base` (or of a plain date-partitioned table); the
    date bounds become `event_date` predicates (partition pruning), the time bounds row
    filters."""
    bounds = []
    if start is not None:
        s = F.lit(start).cast("timestamp_ntz")
        bounds += [F.col("event_date") >= F.to_date(s), F.col("ts") >= s]
    if end is not None:
        e = F.lit(end).cast("timestamp_ntz")
        bounds += [F.col("event_date") <= F.to_date(e), F.col("ts") <= e]
    if is_event_store(spark, base):
        return read_event_store(spark, base, conj(bounds))
    return spark.read.parquet(base).where(conj(bounds))


def event_source(df: DataFrame, predicate=None, fields: list[str] | None = None) -> DataFrame:
    """SRC-8: re-read stored events with a filter and a projected field list."""
    out = df.where(predicate) if predicate is not None else df
    return out.select(*fields) if fields else out


def read_labelled_domains(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: `Domain, Target, Botnet_Family` CSV -> (domain, target, family)."""
    df = spark.read.option("header", "true").csv(path)  # columns by their names in the header
    missing = [c for c in ("Domain", "Target", "Botnet_Family") if c not in df.columns]
    if missing:
        raise ValueError(f"labelled CSV lacks columns {missing}")
    kinds = {f.name: f.dataType for f in LABELLED_SCHEMA.fields}
    return df.select(*[F.col(c).cast(kinds[c]).alias(n) for c, n in (("Domain", "domain"), ("Target", "target"), ("Botnet_Family", "family"))])


def read_knowledge_docs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: recursive *.md files, whole text; source = path, category =
    parent directory, title = file stem."""
    df = (spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
          .text(path, wholetext=True))
    p = F.col("_metadata.file_path")
    parts = F.split(p, "/")
    return df.select(F.col("value").alias("content"), p.alias("source"),
                     F.element_at(parts, -2).alias("category"),
                     F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("title"))


def read_metadata_table(df: DataFrame, filters: dict | None = None, order_col: str | None = None,
                        limit: int | None = None) -> DataFrame:
    """SRC-11: equality filters (None ignored), newest first, cap."""
    out = df
    for k, v in (filters or {}).items():
        if v is not None:
            out = out.where(F.col(k) == F.lit(v))
    if order_col:
        out = out.orderBy(F.desc(order_col))
    return out.limit(limit) if limit else out
