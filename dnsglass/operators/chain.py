"""The alert chain: triage, then explanation and threat intelligence, then response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import severity_scale
from .explain import explain_rows
from .rules import ioc_match, response_actions


def with_severity(df: DataFrame, score: str = "score") -> DataFrame:
    """`triage_severity` (scale C of score or correlated_count) and `triage_confidence`."""
    severity = severity_scale("C", F.coalesce(F.col(score), F.lit(0.0)), correlated=F.col("correlated_count"))
    confidence = F.when(severity == "CRITICAL", 0.95).when(severity == "HIGH", 0.85).when(severity == "MEDIUM", 0.7).otherwise(0.5)
    return df.withColumn("triage_severity", severity).withColumn("triage_confidence", confidence)


def alert_chain(triaged: DataFrame, intel: DataFrame) -> dict[str, DataFrame]:
    """The four outputs for triaged alerts (event_id, ts, domain, src_ip, score, family,
    correlated_count, triage_severity, triage_confidence): one triage and one
    threat_intel row an alert, four explanation rows, one response row for each action of
    its triage severity.  `intel` holds indicators (kind domain / ip, entry, source, tag)."""
    alerts = triaged.withColumn("severity", F.col("triage_severity"))
    if "family" not in alerts.columns:
        alerts = alerts.withColumn("family", F.lit(None).cast("string"))

    def of(kind: str) -> DataFrame:
        return intel.filter(F.col("kind") == kind).select("entry", "source", "tag")

    return {
        "triage": alerts.select("event_id", "ts", "domain", "src_ip", "score", "correlated_count", "severity",
                                F.col("triage_confidence").alias("confidence")),
        "threat_intel": ioc_match(alerts.select("event_id", "ts", "domain", "src_ip"), of("domain"), of("ip")),
        "explain": explain_rows(alerts).select("event_id", "ts", "dim", "title", "text"),
        "response": response_actions(alerts).select("event_id", "ts", "severity", "action_idx", "action", "target", "auto_execute", "level"),
    }
