"""Registered queries of the operators: `(spark, sf_dir) -> DataFrame` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, langid, minhash, quality, queries_words, spotsigs, suffix_dedup, token_counts, url_filter
from .tables import parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


@register("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(parquet(spark, sf_dir, "documents"))


@register("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(parquet(spark, sf_dir, "documents"))


@register("op7_minhash")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(parquet(spark, sf_dir, "documents"))


@register("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


@register("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


@register("op2_langid")
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(parquet(spark, sf_dir, "documents"))


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(parquet(spark, sf_dir, "documents"))


@register("op3_spotsigs")
def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(parquet(spark, sf_dir, "documents"))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures from `pages`, which has no fetch times: a day for each page_id."""
    return parquet(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 365) as int))").alias("fetched"))


def _entries(captures: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of the captures and their parent domains."""
    hosts = captures.select(url_filter.host(F.col("url")).alias("h")).filter("h <> ''").distinct()
    parents = hosts.select(F.expr("substring(h, instr(h, '.') + 1)").alias("h")).filter("h like '%.%'").distinct()

    def entry(rows: DataFrame, name: str, kind: str, pattern: str, action: str, day: str) -> DataFrame:
        return rows.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"), F.lit(action).alias("action"),
                           F.expr(f"date_add(date'2024-01-01', {day})").alias("day"))

    start = "length(h) * 29 % 200 + ascii(h) % 13"
    return (entry(hosts, "hosts", "block", "h", "add", start)
            .union(entry(hosts, "hosts", "block", "h", "remove", f"{start} + 30 + length(h) * 7 % 60"))
            .union(entry(hosts, "hosts", "block", "h", "add", f"{start} + 150"))
            .union(entry(hosts, "exceptions", "allow", "concat(h, '/en')", "add", "length(h) * 17 % 300"))
            .union(entry(hosts, "exceptions", "allow", "concat(h, '/en')", "remove", "length(h) * 17 % 300 + 100"))
            .union(entry(parents, "domains", "block", "h", "add", "length(h) * 11 % 300 - 31")))


OP4_SQL = r"""
WITH cap AS (
  SELECT page_id, url, date '2024-01-01' + CAST((page_id * 37) % 365 AS integer) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment
  FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM cap WHERE host <> ''),
parents AS (SELECT DISTINCT substring(h, instr(h, '.') + 1) AS h FROM hosts WHERE substring(h, instr(h, '.') + 1) LIKE '%.%'),
entries AS (
  SELECT 'hosts' AS list, 0 AS allow, h AS pattern, 0 AS removed, length(h) * 29 % 200 + ascii(h) % 13 AS d FROM hosts
  UNION ALL SELECT 'hosts', 0, h, 1, length(h) * 29 % 200 + ascii(h) % 13 + 30 + length(h) * 7 % 60 FROM hosts
  UNION ALL SELECT 'hosts', 0, h, 0, length(h) * 29 % 200 + ascii(h) % 13 + 150 FROM hosts
  UNION ALL SELECT 'exceptions', 1, h || '/en', 0, length(h) * 17 % 300 FROM hosts
  UNION ALL SELECT 'exceptions', 1, h || '/en', 1, length(h) * 17 % 300 + 100 FROM hosts
  UNION ALL SELECT 'domains', 0, h, 0, length(h) * 11 % 300 - 31 FROM parents),
daily AS (SELECT list, allow, pattern, date '2024-01-01' + CAST(d AS integer) AS since, max(removed) AS removed FROM entries GROUP BY 1, 2, 3, 4),
valid AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, allow, pattern ORDER BY since) AS until FROM daily) WHERE removed = 0),
labels AS (SELECT page_id, url, fetched, host, segment, string_split(host, '.') AS l FROM cap WHERE host <> ''),
asked AS (
  SELECT page_id, fetched, array_to_string(l[i:], '.') AS pattern FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels)
  UNION ALL SELECT page_id, fetched, host || '/' || segment FROM labels WHERE segment <> ''),
best AS (
  SELECT page_id, list, allow, a.pattern, since,
         row_number() OVER (PARTITION BY page_id ORDER BY length(a.pattern) DESC, allow DESC, since DESC, list DESC) AS r
  FROM asked a JOIN valid v ON a.pattern = v.pattern AND v.since <= a.fetched AND (v.until IS NULL OR a.fetched < v.until))
SELECT c.page_id, c.url, c.fetched, CASE WHEN b.page_id IS NULL THEN 'unlisted' WHEN b.allow = 1 THEN 'allowed' ELSE 'blocked' END AS verdict,
       b.list, b.pattern, b.since
FROM cap c LEFT JOIN best b ON b.page_id = c.page_id AND b.r = 1
"""


@register("op4_url_filter", OP4_SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    return url_filter.evaluate(captures, _entries(captures)).select("page_id", "url", "fetched", "filter.*")


@register("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(parquet(spark, sf_dir, "pages"))


QUERIES |= queries_words.QUERIES
