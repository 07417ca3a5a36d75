"""Read-only ad-hoc SQL over registered views (SQL-1).

Spark's own parser judges a statement: it must be one statement and a query.  Its plan is
walked node by node: each relation must be an allowed view, or a WITH name in whose scope
it stands, so a path (parquet.`/...`) or another table is refused wherever it is.
Functions that call the JVM, scripts, other table functions and names made up at run time
are refused too.  Spark SQL then runs the statement, so predicates and projections reach
the Parquet scans like any DataFrame query.
"""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# Fixed values (must equal the reference)
FORBIDDEN_KEYWORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "TRUNCATE",
                      "GRANT", "REVOKE", "EXEC", "EXECUTE", "INTO OUTFILE", "LOAD DATA"]
DEFAULT_ALLOWED = ["dga_events", "model_versions", "pipeline_operations", "feedback"]


class SQLRejected(ValueError):
    pass


_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_WORD = re.compile(r"/\*.*?\*/|--[^\n]*|(\w+)", re.S)
#: Functions that reach the JVM or files beside the tables.
UNSAFE_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
#: Table functions that make rows from their arguments alone.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}


class _Reader:
    """What a parsed plan names: `tables` outside of its WITH scopes, and `refused`."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway
        self.tables: set[str] = set()
        self.refused: set[str] = set()

    def _is(self, x, name: str) -> bool:
        return is_instance_of(self.gateway, x, name)

    def _items(self, x) -> list:
        """The members of a Scala collection, option or product."""
        if self._is(x, "scala.Option"):
            return [x.get()] if x.isDefined() else []
        it = x.iterator() if self._is(x, "scala.collection.Iterable") else x.productIterator()
        out = []
        while it.hasNext():
            out.append(it.next())
        return out

    def walk(self, x, scope: frozenset[str] = frozenset()) -> None:
        if not hasattr(x, "getClass"):
            return  # a plain value
        if self._is(x, _LOGICAL + "UnresolvedWith"):
            for entry in self._items(x.cteRelations()):
                name, query, *_ = self._items(entry)
                self.walk(query, scope | {name.lower()} if x.allowRecursion() else scope)
                scope = scope | {name.lower()}
            self.walk(x.child(), scope)
            return
        kind = x.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = self._items(x.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in scope:
                self.tables.add(".".join(parts))
            return
        if kind in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTableValuedFunction"):
            parts = self._items(x.name()) if kind == "UnresolvedTableValuedFunction" else \
                [x.name().funcName()] if kind == "UnresolvedGenerator" else self._items(x.nameParts())
            if len(parts) > 1 or parts[0].lower() in UNSAFE_FUNCTIONS or (
                    kind == "UnresolvedTableValuedFunction" and parts[0].lower() not in TABLE_FUNCTIONS):
                self.refused.add(".".join(parts))
        elif "ScriptTransformation" in kind or kind.endswith("UnresolvedIdentifier"):
            self.refused.add("TRANSFORM" if "Script" in kind else "IDENTIFIER")
        if any(self._is(x, t) for t in ("scala.collection.Iterable", "scala.Option", "scala.Product")):
            for y in self._items(x):
                self.walk(y, scope)


def validate_sql(sql: str, allowed=DEFAULT_ALLOWED, spark: SparkSession | None = None) -> str | None:
    """None when acceptable, else the reason it is rejected."""
    spark = spark or SparkSession.active()
    words = " ".join(m[1].upper() for m in _WORD.finditer(sql) if m[1])
    for banned in FORBIDDEN_KEYWORDS:
        if f" {banned} " in f" {words} ":
            return f"{banned} may not be used"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (ParseException, Py4JJavaError) as e:
        return f"not one SQL statement: {e}"
    gateway = spark.sparkContext._gateway
    if any(is_instance_of(gateway, plan, _LOGICAL + kind) for kind in ("Command", "ParsedStatement")) or not words.startswith(("SELECT", "WITH")):
        return "not a query"
    reader = _Reader(spark)
    reader.walk(plan)
    if reader.refused:
        return "may not be used: " + ", ".join(sorted(reader.refused))
    if not reader.tables:
        return "no allowed table is read"
    if strange := sorted(n for n in reader.tables if n.lower() not in {a.lower() for a in allowed}):
        return "not among the allowed tables: " + ", ".join(strange)
    return None


def ad_hoc_sql(spark: SparkSession, sql: str, allowed=DEFAULT_ALLOWED) -> DataFrame:
    """Validate, then run one read-only query with `spark.sql` (lazy)."""
    if reason := validate_sql(sql, allowed, spark):
        raise SQLRejected(reason)
    return spark.sql(sql)


def catalog(spark: SparkSession, allowed=DEFAULT_ALLOWED) -> list[tuple[str, list[tuple[str, str]]]]:
    """(table, [(column, type)]) for the allowed views that are registered."""
    out = []
    for t in spark.catalog.listTables():
        if t.name in allowed:
            cols = [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name)]
            out.append((t.name, cols))
    return out


def register_event_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the stored-event view `dga_events` (event_time = ts) and the
    metadata views over the driver tables."""
    from .. import fixtures as fx
    fx.dns_events(spark, sf_dir).withColumnRenamed("ts", "event_time").createOrReplaceTempView("dga_events")
    fx.model_versions_v(spark, sf_dir).createOrReplaceTempView("model_versions")
    fx.operations_v(spark, sf_dir).createOrReplaceTempView("pipeline_operations")
    fx.feedback_v(spark, sf_dir).createOrReplaceTempView("feedback")
