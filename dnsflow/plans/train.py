"""Training and evaluation runs: name classifier, tunnelling forest, holdouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.operators import classifier as cl
from dnsflow.operators import evaluation
from dnsflow.operators.datasets import stratified_split
from dnsflow.operators.evaluation import binary_target
from dnsflow.operators.forest import Forest
from dnsflow.operators.lexical import domain_features
from dnsflow.operators.scale import lookup_join, materialize


@dataclass
class ClassifierRun:
    model: PipelineModel          # refitted on all rows
    metrics: DataFrame            # of the model fitted on the training part
    calibration: dict[str, DataFrame]


def featurized(labelled: DataFrame, rules: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Labelled domains with their eight features."""
    features = materialize(domain_features(labelled, rules, lexicon).drop(
        "registrable_label", "registrable_domain", "suffix_length"))
    return materialize(lookup_join(labelled, features, ["domain"], "inner", spread=["domain", "family"]))


def train_and_evaluate(table: DataFrame, test_share: float = 0.2, seed: int = 42, **fit) -> ClassifierRun:
    """Stratified split, fit, metrics and calibration on the test part, then a fit on everything."""
    split = materialize(stratified_split(table, "domain", test_share=test_share, seed=seed))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    model = cl.train_classifier(train, seed=seed, **fit)
    scored = materialize(cl.score_names(model, test).withColumnRenamed("prob", "p"))
    calibration = {
        "brier": evaluation.brier_score(scored), "severity_tiers": evaluation.severity_tiers(scored),
        "operating_points": evaluation.operating_points(scored), "reliability": evaluation.reliability_table(scored)}
    return ClassifierRun(cl.train_classifier(table, seed=seed, **fit), cl.evaluate_classifier(model, test), calibration)


def flagged_windows(windows: DataFrame, forest: Forest) -> DataFrame:
    """Windows with ``target`` (not normal) and ``predicted``."""
    return forest.score(windows).withColumn("predicted", (F.col("decision") < 0).cast("int")).withColumn(
        "target", binary_target("label"))


def evaluate_forest(windows: DataFrame, forest: Forest) -> dict[str, DataFrame]:
    """Confusion, report, recall per tool and specificity over labelled windows."""
    scored = materialize(flagged_windows(windows, forest))
    return {
        "confusion": evaluation.confusion_matrix(scored, "target"),
        "report": evaluation.classification_report(scored, "target"),
        "per_tool": evaluation.group_recall(scored, "tool", "target"),
        "specificity": evaluation.specificity(scored, "target"),
    }


def realistic_holdout(realistic_normal: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bootstrap normal sessions with the tunnel sessions only."""
    return realistic_normal.unionByName(sessions.where("label = 'tunnel'"), allowMissingColumns=True)
