"""URL filters by a temporal list join, with DataFrame functions only (operator 4).

List entries are dated: on `day`, `pattern` is added to or removed from `list`.  The
entries of a pattern become validity intervals [since, until), until the next entry's
day (open if there is none).  A pattern is a host, one of its parent domains, or a
host with the first segment of the path.  An as-of join evaluates each capture
(url, fetched) against the entries active on the day it was fetched.  The longest
active pattern decides; of equal ones an allow list goes before a block list,
then the later entry, then the list whose name is last.

The join is on (pattern, month): an interval is laid out over the months it touches, so
a host with a long history meets only the few intervals of the month, and the
captures of a busy host are spread over months; equal (host, segment, day) are
evaluated once.

Cases: a null url, a url without host or a null day -> `unlisted`.  Two entries for a
pattern and list on one day: removal wins.  Entries with a null field are ignored.
Repeated captures give repeated rows; no captures or no entries give no rows or only
`unlisted` ones.  Captures keep all their columns, of whatever name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """Lower-case host of a url, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def segment(url: Column) -> Column:
    """First segment of the path."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def patterns(of_host: Column, of_segment: Column) -> Column:
    """All patterns that would match: the host, its parent domains, host/segment."""
    labels = F.split(of_host, r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.when(of_segment != "", F.concat(suffixes, F.array(F.concat(of_host, F.lit("/"), of_segment)))).otherwise(suffixes)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) of dated entries (list, kind, pattern, action, day)."""
    daily = (entries.select("list", "kind", "pattern", "action", "day").dropna()
             .groupBy("list", "kind", "pattern", "day").agg(F.max(F.col("action") == "remove").alias("removed")))
    by_day = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    return (daily.withColumn("until", F.lead("day").over(by_day)).filter(~F.col("removed"))
            .select("list", "kind", "pattern", F.col("day").alias("since"), "until"))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with one more column `filter`: struct<verdict, list, pattern, since>."""
    keyed = captures.select(F.struct("*").alias("row"), F.coalesce(host(F.col(url)), F.lit("")).alias("host"),
                            F.coalesce(segment(F.col(url)), F.lit("")).alias("segment"), F.col(fetched).cast("date").alias("day"))
    asked = keyed.filter("host <> '' and day is not null").select("host", "segment", "day").distinct()
    last = F.lit(asked.agg(F.max("day")).first()[0]).cast("date")  # open intervals are laid out up to there
    valid = (intervals(entries).filter(F.col("since") <= last)
             .withColumn("month", F.explode(F.sequence(F.trunc("since", "month"), F.trunc(F.least("until", last), "month"), F.expr("interval 1 month")))))
    found = (asked.withColumn("pattern", F.explode(patterns(F.col("host"), F.col("segment")))).withColumn("month", F.trunc("day", "month"))
             .join(valid, ["pattern", "month"]).filter("since <= day and (until is null or day < until)")
             .groupBy("host", "segment", "day").agg(F.max(F.struct(
                 F.length("pattern").alias("size"), (F.col("kind") == ALLOW).alias("allow"), "since", "list", "pattern")).alias("best")))
    out = keyed.join(found, ["host", "segment", "day"], "left")
    verdict = F.when(F.col("best").isNull(), "unlisted").when(F.col("best.allow"), "allowed").otherwise("blocked")
    return out.select("row.*", F.struct(verdict.alias("verdict"), F.col("best.list"), F.col("best.pattern"), F.col("best.since")).alias("filter"))
