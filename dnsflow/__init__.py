"""Passive-DNS analytics on Spark: ingest, lexical and window features, detectors, alerts, evaluation."""
