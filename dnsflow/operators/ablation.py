"""Which feature causes the false positives? Rescore normal windows with one feature replaced."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.evaluation import medians
from dnsflow.operators.forest import Forest


def poisson(rate: float, *key: Column | str) -> Column:
    """Poisson draw by inverting its distribution at a hash-derived uniform number."""
    cdf, term, total, k = [], math.exp(-rate), 0.0, 0
    while total < 1 - 1e-12:
        total += term
        cdf.append(total)
        k += 1
        term *= rate / k
    u = (F.pmod(F.xxhash64(*key), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c < u))


def median_replacements(train_normal: DataFrame, forest: Forest) -> dict[str, Column]:
    """Each feature replaced by its median over the normal training windows."""
    found = {r["column"]: r["median"] for r in medians(train_normal, forest.features).collect()}
    return {f: F.lit(float(found[f])) for f in forest.features}


def revisit_replacement(key: str, rate: float = 2.5, seed: int = 42) -> dict[str, Column]:
    """Distinct names as on a host that returns to a few of them."""
    names = F.least(poisson(rate, F.lit(seed), F.col(key)) + 1, F.col("query_rate"))
    return {"unique_subdomains": names.cast("double")}


def false_positive_rates(normal: DataFrame, forest: Forest, replacements: Mapping[str, Column]) -> DataFrame:
    """False-positive rate as measured (``baseline``) and with each feature replaced, in one pass."""
    def variant(name: str, changed: Mapping[str, Column]) -> Column:
        return F.struct(F.lit(name).alias("variant"), *[
            changed.get(f, F.col(f)).cast("double").alias(f) for f in forest.features])
    variants = F.array(
        variant("baseline", {}), *[variant(f, {f: column}) for f, column in replacements.items()])
    rows = normal.select(F.explode(variants).alias("v")).select("v.*")
    rates = forest.score(rows).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("decision") < 0).cast("double")).alias("fp_rate"))
    baseline = F.max(F.when(F.col("variant") == "baseline", F.col("fp_rate")))
    summary = rates.agg(baseline.alias("base"), F.collect_list(F.struct("variant", "n", "fp_rate")).alias("rows"))
    return summary.select("base", F.explode("rows").alias("r")).select(
        "r.*", ((F.col("r.fp_rate") - F.col("base")) * 100).alias("delta_points"))
