"""Batch detection: events -> alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators import alerts as al
from dnsflow.operators.allowlist import suppress
from dnsflow.operators.classifier import score_names
from dnsflow.operators.cooldown import COOLDOWN_US, apply_cooldown
from dnsflow.operators.forest import Forest
from dnsflow.operators.lexical import label_features
from dnsflow.operators.scale import at_once, lookup_join, materialize
from dnsflow.operators.suffix import registrable_names
from dnsflow.operators.windows import BUCKET_US, N_BUCKETS, window_features


@dataclass
class Detector:
    """Models, lists and limits of both detectors; ``None`` switches allowlist or cooldown off."""

    rules: DataFrame
    lexicon: DataFrame
    classifier: PipelineModel | Column
    forest: Forest
    allowlist: DataFrame | None = None
    cooldown_us: int | None = COOLDOWN_US
    threshold: float = al.DGA_THRESHOLD
    min_queries: int = al.MIN_QUERIES
    bucket_us: int = BUCKET_US
    n_buckets: int = N_BUCKETS


def scored_domains(domains: DataFrame, detector: Detector) -> DataFrame:
    """Features and probability of each distinct domain; allowlisted ones never reach the model."""
    names = materialize(registrable_names(domains, detector.rules))
    if detector.allowlist is not None:
        names = suppress(names, detector.allowlist)
    labels = label_features(names, detector.lexicon, "registrable_label")
    scored = materialize(score_names(detector.classifier, labels))
    return lookup_join(names, scored, ["registrable_label"], "inner", spread=["domain"])


def name_alerts(events: DataFrame, detector: Detector) -> DataFrame:
    """DGA alerts: only names above the threshold are joined back to the events."""
    scored = scored_domains(events, detector).where(F.col("prob") > detector.threshold)
    flagged = materialize(scored.drop("registrable_label", "registrable_domain", "suffix_length"))
    hits = lookup_join(events.drop("length"), flagged, ["domain"], "inner", spread=["seq"])
    return al.dga_alerts(hits, detector.threshold)


def window_alerts(features: DataFrame, detector: Detector) -> DataFrame:
    """Tunnelling alerts of windows with enough queries."""
    enough = features.where(F.col("query_rate") >= detector.min_queries)
    if "ts" not in features.columns:
        enough = enough.withColumn("ts", F.col("ts_us") / 1_000_000)
    return al.tunnelling_alerts(detector.forest.score(enough))


def raw_alerts(events: DataFrame, detector: Detector) -> DataFrame:
    """Alerts of both detectors, each written once; the detectors run side by side.

    ``events`` is read several times: pass a table, or materialize a parsed log first.
    """
    def from_windows() -> DataFrame:
        return window_alerts(window_features(events, detector.bucket_us, detector.n_buckets), detector)
    by_name, by_window = at_once(
        lambda: materialize(name_alerts(events, detector)), lambda: materialize(from_windows()))
    return by_name.unionByName(by_window)


def detect(events: DataFrame, detector: Detector) -> DataFrame:
    """All alerts after the cooldown, with arrival number."""
    return apply_cooldown(raw_alerts(events, detector), detector.cooldown_us)


def in_order(alerts: DataFrame) -> DataFrame:
    """Public columns in time and arrival order."""
    return al.public_columns(alerts.orderBy("timestamp", "seq", "threat_class"))
