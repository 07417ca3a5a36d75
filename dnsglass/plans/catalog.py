"""Registry of named queries: Spark callables `(spark, sf_dir) -> DataFrame` and
their DuckDB oracle statements (same column names, doubles rounded to 6 dp).

Each callable reads the driver tables through `dnsglass.fixtures` (rows in the
schema the operator expects) and then runs the library operator on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# Import the modules that register queries (order = registration order).
from . import q_alerts, q_reports, q_rules, q_loops, q_stats, q_text, q_ml, q_io, q_store  # noqa: E402,F401
