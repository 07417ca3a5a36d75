"""Shared relational recipes (top-k, broadcast guards, lineage cuts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conj(preds: list[Column]) -> Column:
    """AND of optional predicates; TRUE when none."""
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Exact top-k rows per group via `row_number() <= k`.

    Catalyst turns the filter into a WindowGroupLimit that runs *before* the
    shuffle (partial) and after it (final), so a hot group never ships more
    than k rows per map task: a key holding a third of all rows is cut down
    map-side, nothing is collected into one task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_k(df: DataFrame, order_cols: list[Column], k: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order_cols).limit(k)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into `spark.checkpoint.dir` (shared storage on a
    cluster), so a lost executor does not replay a long lineage."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def running_totals(df: DataFrame, order_col: str, cols: list[str], descending: bool = True,
                   partition_cols: list[str] | None = None) -> DataFrame:
    """Exact running sums of `cols` in `order_col` order (per `partition_cols`
    group when given) without a single-task window.

    Rows are range-partitioned on (group, order); per (partition, group)
    totals give each slice its offset (a window over one row per slice), and
    the running sum inside a slice is a window partitioned by (partition,
    group).  A group larger than a partition is spread over several tasks."""
    from pyspark.sql import Window
    keys = list(partition_cols or [])
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    r = df.repartitionByRange(*[F.col(k).asc() for k in keys], o).withColumn("_pid", F.spark_partition_id())
    r = cut_lineage(r)  # freeze the partition assignment before it is used twice
    tot = r.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_p = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{c}").over(w_p), F.lit(0)).alias(f"_o_{c}") for c in cols])
    w = Window.partitionBy("_pid", *keys).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = r.join(off, ["_pid", *keys])
    return out.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])


def exact_percentile(df: DataFrame, group_cols: list[str], value: str, q: float) -> DataFrame:
    """Exact linear-interpolated percentile per group (the definition of
    Spark's `percentile`) without holding a group's values in one task:
    counts per distinct value, grouped running totals, then the two ranks
    around q * (n - 1) are looked up and interpolated."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_n"))
    rt = running_totals(c, value, ["_n"], descending=False, partition_cols=group_cols)
    tot = c.groupBy(*group_cols).agg(F.sum("_n").alias("_total"))
    j = rt.join(tot, group_cols)
    k = F.lit(q) * (F.col("_total") - 1)
    lo, hi = F.floor(k), F.ceil(k)
    first = F.col("cum__n") - F.col("_n")           # 0-based position of the value's first copy
    last = F.col("cum__n") - 1
    j = j.withColumn("_k", k).withColumn("_cov_lo", (first <= lo) & (lo <= last)).withColumn(
        "_cov_hi", (first <= hi) & (hi <= last))
    sel = j.where(F.col("_cov_lo") | F.col("_cov_hi"))
    g = sel.groupBy(*group_cols).agg(
        F.max(F.when(F.col("_cov_lo"), F.col(value))).alias("_vlo"),
        F.max(F.when(F.col("_cov_hi"), F.col(value))).alias("_vhi"), F.first("_k").alias("_k"))
    p = F.col("_vlo") + (F.col("_k") - F.floor("_k")) * (F.col("_vhi") - F.col("_vlo"))
    return g.select(*group_cols, p.alias("percentile"))
