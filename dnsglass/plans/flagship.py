"""Flagship query: stored DNS events -> domain features -> allow / deny lists
-> per-tenant threshold and severity -> alerts grouped by domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..operators import alerts as A
from ..operators import ingest as IN
from ..operators import rules as RU

TENANT_THRESHOLDS = {"finance": 0.5, "dev": 0.9}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.dns_events(spark, sf_dir)
    lists = fx.list_entries(spark, sf_dir)
    d = IN.extract_features(events, ("lexical", "entropy"))
    d = RU.allowlist(d, static=[], lists=lists)
    d = RU.denylist(d, static=[], lists=lists)
    d = RU.apply_threshold(d, 0.7, TENANT_THRESHOLDS)
    return A.alerts_by_domain(d.where("is_dga"), size=200)
