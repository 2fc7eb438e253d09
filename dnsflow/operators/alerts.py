"""Alert rows in one schema, and the reports over an alert log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.schemas import ALERT, DGA, EVIDENCE, LEXICAL_FEATURES, TUNNELLING, WINDOW_FEATURES

DGA_THRESHOLD = 0.5
MIN_QUERIES = 5
SEVERITY_CUTS = (("CRITICAL", 0.85), ("HIGH", 0.60), ("MEDIUM", 0.30))


def severity(confidence: Column, cuts: Sequence[tuple[str, float]] = SEVERITY_CUTS, below: str = "LOW") -> Column:
    level = F.lit(below)
    for name, cut in reversed(cuts):
        level = F.when(confidence >= cut, name).otherwise(level)
    return level


def alert_rows(
    fired: DataFrame, threat_class: str, flow_id: str, confidence: Column, evidence: Sequence[str]
) -> DataFrame:
    """Alerts with their arrival number; the time is the observed one, wall clock only without any."""
    present = set(evidence)
    details = F.struct(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVIDENCE])
    observed = F.coalesce(F.col("ts"), F.unix_micros(F.current_timestamp()) / 1_000_000)
    # Each part follows its length, so no two alerts share an id, and a replay gives the same ones.
    parts = (F.lit(threat_class), F.col(flow_id), F.col("src_ip"), F.col("seq").cast("string"), F.col("ts_us").cast("string"))
    identity = F.sha2(F.concat(*[
        F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x, F.lit("")) for x in parts)]), 256)
    return fired.select(
        identity.alias("alert_id"), observed.alias("timestamp"), F.col(flow_id).alias("flow_id"),
        F.lit(threat_class).alias("threat_class"), severity(confidence).alias("severity"),
        confidence.cast("double").alias("confidence"), details.alias("evidence"), "seq", "ts_us")


def dga_alerts(scored: DataFrame, threshold: float = DGA_THRESHOLD) -> DataFrame:
    """One alert per event whose name scores above the threshold; the flow is the queried name."""
    return alert_rows(
        scored.where(F.col("prob") > threshold), DGA, "domain", F.col("prob"), (*LEXICAL_FEATURES, "src_ip"))


def tunnelling_alerts(scored: DataFrame) -> DataFrame:
    """One alert per window with a negative decision; the flow is the source address."""
    fired = scored.where(F.col("decision") < 0)
    return alert_rows(fired, TUNNELLING, "src_ip", F.least(-F.col("decision"), F.lit(1.0)), WINDOW_FEATURES)


def public_columns(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERT.fieldNames())


def count_by(alerts: DataFrame, column: str = "severity") -> DataFrame:
    return alerts.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)


def alert_log(alerts: DataFrame) -> DataFrame:
    """Newest first, with a readable time."""
    return alerts.select(
        F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("long")).alias("time"),
        "threat_class", "severity", "flow_id", "confidence").orderBy(F.col("time").desc())


def first_alert_per_flow(alerts: DataFrame) -> DataFrame:
    columns = [c for c in alerts.columns if c != "flow_id"]
    return alerts.groupBy("flow_id").agg(F.min_by(F.struct(*columns), "seq").alias("first")).select(
        "flow_id", "first.*")
