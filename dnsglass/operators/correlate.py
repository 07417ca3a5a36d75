"""Interval correlation by source, triage, rate limits, sliding per-source
features and NXDOMAIN ratios.

Skew: every per-key time window here runs on (key, time chunk) partitions.
Rows within `halo` of a chunk edge are copied into the neighbouring chunk as
context rows that are counted but never emitted, so each emitted row sees its
complete ±window inside its own partition.  A source IP holding a third of
all events is therefore spread over as many tasks as it has chunks, and no
pair list is ever materialised.  Counts, sums and means of a window are differences
of two frames that only grow, so a chunk costs its sort and one pass however many
rows a window holds; distinct counts are a running sum of domains that enter and
leave the window; neighbour lists come from an equi-join on row positions bounded
by n per anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import shannon_entropy
from .chain import with_severity

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
DEFAULT_CHUNK_SEC = 3600   # neighbour lists
CHUNK_HALOS = 4            # aggregates: a chunk is so many halos long, at most half of its rows are copies


def ts_micros(col: str = "ts") -> Column:
    """Microseconds since epoch of a TIMESTAMP_NTZ (or TIMESTAMP) column,
    independent of the session time zone for NTZ input."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH_NTZ}, cast({col} as timestamp_ntz))")


def with_halo(df: DataFrame, ts_us: str, halo_us: int, chunk_us: int) -> DataFrame:
    """Each row once in its own chunk (`_own` = true) and, when it lies within
    `halo_us` of a chunk edge, once more in that neighbour chunk (`_own` = false)."""
    c = F.floor(F.col(ts_us) / chunk_us)
    lo_nb = F.when(F.col(ts_us) - c * chunk_us < halo_us, c - 1)
    hi_nb = F.when((c + 1) * chunk_us - F.col(ts_us) <= halo_us, c + 1)
    arr = F.filter(F.array(F.struct(c.alias("chunk"), F.lit(True).alias("own")),
                           F.struct(lo_nb.alias("chunk"), F.lit(False).alias("own")),
                           F.struct(hi_nb.alias("chunk"), F.lit(False).alias("own"))),
                   lambda s: s["chunk"].isNotNull())
    return df.select("*", F.inline(arr)).withColumnRenamed("chunk", "_chunk").withColumnRenamed("own", "_own")


def range_aggregate(df: DataFrame, key: str, ts_us: str, before_us: int, after_us: int,
                    aggs: dict[str, tuple[str, str | None]], chunk_us: int | None = None) -> DataFrame:
    """For every row: aggregates over rows of the same key whose time lies in
    [t - before_us, t + after_us] (inclusive), skew-safe via chunk + halo.

    `aggs` maps an output name to ("count", None), ("sum", column), ("avg", column)
    or ("distinct", column); the last needs a trailing window (after_us = 0).
    Means of no value and sums of no value are null.  Fractional columns are summed
    as decimals with 12 places, so a difference of prefix sums is exact."""
    halo = max(before_us, after_us)
    chunk_us = chunk_us or max(CHUNK_HALOS * halo, 1_000_000)
    h = with_halo(df, ts_us, halo, chunk_us)
    part = Window.partitionBy(key, "_chunk").orderBy(ts_us)
    upto = part.rangeBetween(Window.unboundedPreceding, after_us)
    below = part.rangeBetween(Window.unboundedPreceding, -before_us - 1)

    def between(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(upto), F.lit(0)) - F.coalesce(F.sum(value).over(below), F.lit(0))

    kinds = dict(df.dtypes)
    cols = []
    for name, (kind, col) in aggs.items():
        if kind == "count":
            cols.append(between(F.lit(1).cast("long")).alias(name))
        elif kind in ("sum", "avg"):
            fraction = kinds[col] in ("double", "float")
            value = F.col(col).cast("decimal(26,12)") if fraction else F.col(col).cast("long")
            n = between(F.col(col).isNotNull().cast("long"))
            total = between(value)
            total = total.cast("double") if fraction or kind == "avg" else total
            cols.append(F.when(n > 0, total / n if kind == "avg" else total).alias(name))
    own = h.select("*", *cols)
    for name, (kind, col) in aggs.items():
        if kind == "distinct":
            if after_us:
                raise ValueError("distinct counts need a trailing window")
            own = _distinct_in_window(own, key, ts_us, before_us, col, name)
    return own.where("_own").drop("_chunk", "_own")


def _distinct_in_window(h: DataFrame, key: str, ts_us: str, before_us: int, col: str, name: str) -> DataFrame:
    """Distinct non-null values of `col` in [t - before_us, t] per (key, chunk).  A value
    enters at a row and leaves at its next occurrence or just after the window,
    whichever is first; the count is the running sum of entries and exits."""
    again = F.lead(ts_us).over(Window.partitionBy(key, "_chunk", col).orderBy(ts_us))
    present = F.col(col).isNotNull()
    h = h.withColumn("_leave", F.least(again, F.col(ts_us) + before_us + 1))
    rows = [c for c in h.columns if c != "_leave"]
    steps = h.select(*rows, F.inline(F.array(
        F.struct(F.col(ts_us).alias("_at"), present.cast("int").alias("_step"), F.lit(True).alias("_row")),
        F.struct(F.col("_leave").alias("_at"), (-present.cast("int")).alias("_step"), F.lit(False).alias("_row")))))
    running = Window.partitionBy(key, "_chunk").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(name, F.sum("_step").over(running)).where("_row").select(*rows, name)


# --- JOI-5 / JOI-6 -----------------------------------------------------------------------

def correlate(df: DataFrame, window_sec: int = 300, key: str = "src_ip") -> DataFrame:
    """Adds `correlated_count`: events with the same src_ip within ±window
    (the event itself included)."""
    w = window_sec * 1_000_000
    d = df.where(F.col(key).isNotNull()).withColumn("_t", ts_micros("ts"))
    out = range_aggregate(d, key, "_t", w, w, {"correlated_count": ("count", None)})
    return out.drop("_t")


def correlated_events(df: DataFrame, anchors: DataFrame, window_sec: int = 300, n: int = 50,
                      key: str = "src_ip", id_col: str = "event_id") -> DataFrame:
    """For each anchor event: up to n newest other events of the same src_ip
    within ±window.  Positions inside the (key, chunk) partition are numbered;
    the anchor's window is a position interval, of which only the last n + 1
    positions are generated and equi-joined: at most n + 1 rows per anchor."""
    w = window_sec * 1_000_000
    chunk_us = max(DEFAULT_CHUNK_SEC * 1_000_000, 2 * w)
    d = df.where(F.col(key).isNotNull()).select(key, id_col, "ts").withColumn("_t", ts_micros("ts"))
    h = with_halo(d, "_t", w, chunk_us)
    part = Window.partitionBy(key, "_chunk")
    ordered = part.orderBy("_t", id_col)
    h = h.withColumn("_pos", F.row_number().over(ordered))
    rng = part.orderBy("_t")
    h = (h.withColumn("_hi", F.count(F.lit(1)).over(rng.rangeBetween(Window.unboundedPreceding, w)))
          .withColumn("_below", F.count(F.lit(1)).over(rng.rangeBetween(Window.unboundedPreceding, -w - 1))))
    a = (h.where("_own").join(anchors.select(F.col(id_col).alias("_aid")).distinct(),
                              F.col(id_col) == F.col("_aid"), "left_semi")
         .select(F.col(key).alias("_k"), "_chunk", F.col(id_col).alias("anchor_id"),
                 F.explode(F.sequence(F.greatest(F.col("_below") + 1, F.col("_hi") - n), F.col("_hi"))).alias("_p")))
    cand = h.select(F.col(key).alias("_k"), "_chunk", F.col("_pos").alias("_p"), id_col, "ts")
    j = a.join(cand, ["_k", "_chunk", "_p"]).where(F.col(id_col) != F.col("anchor_id"))
    r = Window.partitionBy("anchor_id").orderBy(F.desc("_p"))
    j = j.withColumn("rank", F.row_number().over(r)).where(F.col("rank") <= n)
    return j.select("anchor_id", F.col("_k").alias(key), id_col, "ts", "rank")


def triage(df: DataFrame, window_sec: int = 300) -> DataFrame:
    """Severity scale C from score or correlated count; confidence .95/.85/.7/.5."""
    return with_severity(correlate(df, window_sec))


# --- WIN-3 / WIN-4 --------------------------------------------------------------------------

def rate_limit(df: DataFrame, key: str = "key", limit: int = 600, window_sec: int = 60) -> DataFrame:
    """Shared-store limiter: count of requests of the key in (t - w, t]
    (rejected ones count too); allowed when count <= limit."""
    w = window_sec * 1_000_000
    d = df.withColumn("_t", ts_micros("ts"))
    out = range_aggregate(d, key, "_t", w - 1, 0, {"window_count": ("count", None)})
    return out.withColumn("allowed", F.col("window_count") <= limit).drop("_t")


def rate_limit_strict(df: DataFrame, key: str = "key", limit: int = 600, window_sec: int = 60,
                      id_col: str = "request_id") -> DataFrame:
    """In-process limiter: only accepted requests count, so each decision depends on the
    previous ones of the same key.  Output (key, id, ts, allowed); ties of ts go by id, a
    null key is a key.

    A key's time line is cut where the limiter's state is known.  A request whose window
    (t - w, t] holds at most `limit` requests at all is accepted whatever was decided
    before.  In slots of one window length, a slot with other requests depends on its own
    requests and those of the slot before; if that one has none of them either, all of its
    requests are accepted, and so the state is known.  So neighbouring slots with open
    requests, with the slot before them, make an island that is solved by itself, and all
    requests outside the islands are accepted at once.  A key with a third of all
    requests takes as many tasks as it has islands; only a key that is over its limit
    without a pause is one island.  An island is streamed through a task in order, with at
    most `limit` times in memory, and rejected requests are skipped by binary search."""
    w_us = window_sec * 1_000_000
    d = df.select(key, id_col, "ts", ts_micros("ts").alias("_t"))
    d = range_aggregate(d, key, "_t", w_us - 1, 0, {"_n": ("count", None)}).withColumn("_slot", F.floor(F.col("_t") / w_us))
    busy = d.where(F.col("_n") > limit).select(F.col(key).alias("_key"), F.col("_slot").alias("_at")).distinct()
    by_time = Window.partitionBy("_key").orderBy("_at")  # a row per slot, not per request
    first = F.coalesce(F.col("_at") - F.lag("_at").over(by_time) > 1, F.lit(True))
    islands = busy.withColumn("_first", first).withColumn("_island", F.max(F.when(F.col("_first"), F.col("_at"))).over(by_time))
    slots = islands.select("_key", "_island", F.explode(F.when(F.col("_first"), F.array(F.col("_at") - 1, F.col("_at"))).otherwise(F.array("_at"))).alias("_at"))
    d = d.join(slots, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")), "left")
    d = d.select(key, id_col, "ts", "_t", "_island").withColumn(
        "_route", F.when(F.col("_island").isNotNull(), F.xxhash64(key, "_island")).otherwise(F.xxhash64(key, id_col, "_t")))
    d = d.repartition("_route").sortWithinPartitions(key, "_island", "_t", id_col)

    def scan(it):
        now, accepted = None, []  # of the island at hand: the accepted times of the last window
        for pdf in it:
            times, island = pdf["_t"].to_numpy(), pdf["_island"].to_numpy(dtype=float, na_value=np.nan)
            names = pdf[key].where(pdf[key].notna(), None).tolist()
            allowed = np.isnan(island)
            rows = np.flatnonzero(~allowed)
            edges = [i for i in range(len(rows)) if i == 0 or (names[rows[i]], island[rows[i]]) != (names[rows[i - 1]], island[rows[i - 1]])] + [len(rows)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = rows[a:b]
                if (names[part[0]], island[part[0]]) != now:
                    now, accepted = (names[part[0]], island[part[0]]), []
                t, i = times[part], 0
                while i < len(t):
                    if len(accepted) >= limit:
                        free = accepted[-limit] + w_us  # when the oldest that counts leaves the window
                        if t[i] < free:
                            i += int(np.searchsorted(t[i:], free))
                            continue
                    accepted.append(t[i])
                    allowed[part[i]] = True
                    i += 1
                    if len(accepted) > 2 * limit + 1000:
                        del accepted[:-limit]
            yield pdf.assign(allowed=allowed)[[key, id_col, "ts", "allowed"]]

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}, " \
             f"ts {df.schema['ts'].dataType.simpleString()}, allowed boolean"
    return d.mapInPandas(scan, schema)


# --- WIN-8 ------------------------------------------------------------------------------------

def sliding_domain_features(df: DataFrame, window_sec: int = 120, key: str = "src_ip") -> DataFrame:
    """Per source over the trailing window [t - w, t]: query count, distinct
    domains, mean domain entropy and total response bytes."""
    w = window_sec * 1_000_000
    d = (df.where(F.col(key).isNotNull()).withColumn("_t", ts_micros("ts"))
         .withColumn("_h", shannon_entropy(F.col("domain"))))
    out = range_aggregate(d, key, "_t", w, 0, {
        "win_queries": ("count", None),
        "win_domains": ("distinct", "domain"),
        "win_mean_entropy": ("avg", "_h"),
        "win_response_bytes": ("sum", "response_size"),
    })
    return out.drop("_t", "_h")


# --- AGG-23 / STR-5 (batch) -------------------------------------------------------------------

def nxdomain_ratio(df: DataFrame, key: str = "src_ip") -> DataFrame:
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_nx") == F.lit(True)).alias("nx"))
    return g.withColumn("nx_ratio", F.col("nx") / F.greatest(F.col("total"), F.lit(1)))


def nxdomain_sessions(df: DataFrame, window_sec: int = 60, key: str = "src_ip") -> DataFrame:
    """Counters whose expiry (2 x window) is refreshed by every query:
    sessions with gap 2 x window per source; nx share per session."""
    gap = f"{2 * window_sec} seconds"
    s = df.where(F.col(key).isNotNull()).groupBy(key, F.session_window("ts", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_nx") == F.lit(True)).alias("nx"))
    return s.select(key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    "total", "nx", (F.col("nx") / F.greatest(F.col("total"), F.lit(1))).alias("nx_ratio"))
