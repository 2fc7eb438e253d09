"""Evaluation and calibration tables for scored rows.

All curves start from one row per distinct score, counted with map-side combining, and use
running totals over score ranges; nothing is sorted in a single task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.scale import order_statistics, order_statistics_of_counts, running_totals

SEVERITY_THRESHOLDS = (0.30, 0.60, 0.85)
FALSE_DISCOVERY_TARGETS = (0.10, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(numerator: str | Column, denominator: str | Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def binary_target(label: str = "label", negative: str = "normal") -> Column:
    return (F.col(label) != negative).cast("int")


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.agg(
        _count(~y & ~p).alias("tn"), _count(~y & p).alias("fp"),
        _count(y & ~p).alias("fn"), _count(y & p).alias("tp"))


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    0/0 counts as 0. Rows: ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg``.
    """
    counts = confusion_matrix(df, label, predicted)
    c = counts.select(
        "*", (F.col("tn") + F.col("fp")).alias("s0"), (F.col("tp") + F.col("fn")).alias("s1"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"))
    c = c.select(
        "*", _ratio("tn", F.col("tn") + F.col("fn")).alias("p0"), _ratio("tn", "s0").alias("r0"),
        _ratio("tp", F.col("tp") + F.col("fp")).alias("p1"), _ratio("tp", "s1").alias("r1"))
    for k in ("0", "1"):
        c = c.withColumn(f"f{k}", _ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), F.col(f"p{k}") + F.col(f"r{k}")))
    accuracy = _ratio(F.col("tn") + F.col("tp"), "n")
    macro = lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2
    weighted = lambda m: _ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), "n")
    line = lambda name, p, r, f, s: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
    return c.select(F.explode(F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", accuracy, accuracy, accuracy, F.col("n")),
        line("macro avg", macro("p"), macro("r"), macro("f"), F.col("n")),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("n")),
    )).alias("line")).select("line.*")


def brier_score(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def score_curve(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Per distinct score: rows and positives at it (``n``, ``pos``) and at or above it (``flagged``, ``tp``)."""
    counted = df.groupBy(F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    ).withColumn("descending", -F.col("score"))
    return running_totals(counted, ["descending"], {"flagged": "n", "tp": "pos"}).drop("descending")


def roc_auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half; NaN with one class only."""
    curve = score_curve(df, label, score)
    neg = F.col("n") - F.col("pos")
    better_negatives = F.col("flagged") - F.col("tp") - neg
    lost = F.sum(F.col("pos").cast("double") * (better_negatives + neg / 2))
    sums = curve.agg(lost.alias("lost"), F.sum("pos").cast("double").alias("p"), F.sum(neg).cast("double").alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), 1 - F.col("lost") / (F.col("p") * F.col("q")))
                       .otherwise(F.lit(math.nan)).alias("auc"))


def precision_recall_curve(df: DataFrame, label: str = "label", score: str = "p", closing: bool = True) -> DataFrame:
    """One point per distinct score, read as "score >= threshold", and the closing point (1, 0)."""
    curve = score_curve(df, label, score)
    positives = df.agg(F.sum(F.col(label).cast("long"))).first()[0] or 0
    recall = F.col("tp") / F.lit(positives) if positives else F.lit(1.0)
    points = curve.select(
        F.col("score").alias("threshold"), (F.col("tp") / F.col("flagged")).alias("precision"),
        recall.cast("double").alias("recall"))
    if not closing:
        return points
    last = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema)
    return points.unionByName(last)


def severity_tiers(
    df: DataFrame, cuts: Sequence[float] = SEVERITY_THRESHOLDS, label: str = "label", score: str = "p"
) -> DataFrame:
    """Precision, recall and number flagged at or above each cut; precision 1 where nothing is flagged."""
    y = F.col(label) == 1
    counts = df.agg(_count(y).alias("pos"), *[
        agg for i, cut in enumerate(cuts) for agg in (
            _count(F.col(score) >= cut).alias(f"n{i}"), _count(y & (F.col(score) >= cut)).alias(f"tp{i}"))])
    return counts.select("pos", F.explode(F.array(*[
        F.struct(F.lit(float(cut)).alias("cut"), F.col(f"n{i}").alias("n_flagged"), F.col(f"tp{i}").alias("tp"))
        for i, cut in enumerate(cuts)])).alias("c")).select(
        "c.cut",
        F.coalesce(F.try_divide("c.tp", "c.n_flagged"), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide("c.tp", "pos"), F.lit(0.0)).alias("recall_at_or_above"),
        F.col("c.n_flagged").alias("n_flagged"))


def operating_points(
    df: DataFrame, targets: Sequence[float] = FALSE_DISCOVERY_TARGETS, label: str = "label", score: str = "p"
) -> DataFrame:
    """Per bound on 1 - precision: the point of highest recall, the lowest threshold among ties; null if none."""
    points = precision_recall_curve(df, label, score, closing=False)
    best = points.agg(*[
        F.max(F.when(1 - F.col("precision") <= target, F.struct(
            "recall", (-F.col("threshold")).alias("negated"), "precision"))).alias(f"t{i}")
        for i, target in enumerate(targets)])
    return best.select(F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("max_false_discovery_rate"), (-F.col(f"t{i}.negated")).alias("threshold"),
                 F.col(f"t{i}.precision").alias("precision"), F.col(f"t{i}.recall").alias("recall"))
        for i, t in enumerate(targets)])).alias("p")).select("p.*")


def reliability_table(df: DataFrame, bins: int = 10, label: str = "label", score: str = "p") -> DataFrame:
    """Mean predicted and observed rate per equal-width bin."""
    bin_no = F.least(F.width_bucket(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return df.groupBy(bin_no.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"))


def group_recall(df: DataFrame, group: str = "tool", label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.where(F.col(label) == 1).groupBy(group).agg(
        F.avg(F.col(predicted).cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def specificity(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    fp_rate = F.avg(F.col(predicted).cast("double"))
    return df.where(F.col(label) == 0).agg(
        F.count(F.lit(1)).alias("n"), fp_rate.alias("fp_rate"), (1 - fp_rate).alias("specificity"))


def feature_means(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(f).alias(f) for f in features])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, minimum and maximum per column, one row each."""
    stats = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in columns
                     for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{n}").alias(n) for n in ("mean", "min", "max")])
        for c in columns])).alias("s")).select("s.*")


def nearest_rank(
    df: DataFrame, value: str, shares: Sequence[float] = (0.50, 0.95, 0.99), group: Sequence[str] = ()
) -> DataFrame:
    """Value at 0-based position ``min(floor(share * n), n - 1)`` of the sorted values, 0 when there are none."""
    at = _nearest(shares)
    out = order_statistics(df, value, at, group)
    return out.select(*group, "n", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in at])


def _nearest(shares: Sequence[float]) -> dict[str, Column]:
    return {f"p{round(s * 100)}": F.least(F.floor(F.lit(float(s)) * F.col("n")), F.col("n") - 1) for s in shares}


def value_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """How often each value occurs (``times``): what a micro-batch leaves for ``nearest_rank_of_counts``."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("times"))


def nearest_rank_of_counts(
    counts: DataFrame, value: str, times: str = "times", shares: Sequence[float] = (0.50, 0.95, 0.99), group: Sequence[str] = ()
) -> DataFrame:
    """``nearest_rank`` of values given by their counts, which may come from many micro-batches: exactly that of all values together."""
    at = _nearest(shares)
    out = order_statistics_of_counts(counts, value, times, at, group)
    return out.select(*group, "n", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in at])


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column: ``(column, median)``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")
    ).select("v.*")
    middle = {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    return order_statistics(long, "value", middle, ["column"]).select(
        "column", ((F.col("low") + F.col("high")) / 2).alias("median"))


def quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """Quantile with linear interpolation between neighbours."""
    position = F.lit(float(share)) * (F.col("n") - 1)
    found = order_statistics(df, value, {"low": F.floor(position), "high": F.ceil(position)})
    return found.select(
        (F.col("low") + (F.col("high") - F.col("low")) * (position - F.floor(position))).alias("quantile"))


def throughput(df: DataFrame, ts_us: str = "ts_us", value: str = "value") -> DataFrame:
    """Rows per second between first and last row, and the mean of ``value``."""
    elapsed = (F.max(ts_us) - F.min(ts_us)) / 1_000_000
    return df.agg(
        F.count(F.lit(1)).alias("n"), elapsed.alias("elapsed_s"),
        F.try_divide(F.count(F.lit(1)), elapsed).alias("per_second"), F.avg(value).alias("mean_value"))


def verdict(baseline_fp: float | Column, revisit_fp: float | Column) -> Column:
    """Does the counterfactual explain the false positives?"""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(as_column(revisit_fp) < as_column(baseline_fp) / 2, "supported").otherwise("not supported")
