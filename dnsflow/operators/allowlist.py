"""Popularity allowlist: suppression and its coverage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.scale import lookup_join, materialize
from dnsflow.operators.suffix import registrable_names


def popular_domains(ranked: DataFrame, rules: DataFrame, top_n: int | None = None) -> DataFrame:
    """Registrable domains of the first ``top_n`` ranks."""
    if top_n is not None:
        ranked = ranked.where(F.col("rank") <= top_n)
    return materialize(registrable_names(ranked, rules).select("registrable_domain").distinct())


def suppress(named: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose ``registrable_domain`` is not allowed."""
    return lookup_join(named, allowed, ["registrable_domain"], "left_anti")


def coverage(named: DataFrame, allowed: DataFrame, label: str = "label") -> DataFrame:
    """Share of rows per label whose registrable domain is on the list."""
    flagged = lookup_join(named, allowed.withColumn("_listed", F.lit(1.0)), ["registrable_domain"], "left")
    return flagged.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count("_listed").alias("n_listed"),
        F.avg(F.coalesce("_listed", F.lit(0.0))).alias("share"))
