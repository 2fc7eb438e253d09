"""Alert log, metric reports and run counters."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dnsflow.schemas import ALERT


def write_alerts(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; absent evidence is left out. ``append`` keeps earlier runs."""
    alerts.write.mode(mode).json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT).json(path)


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite", format: str = "json") -> None:
    metrics.write.mode(mode).format(format).save(path)


def count_run(checked: DataFrame, counters: Observation) -> DataFrame:
    """Count accepted and rejected lines while ``checked`` is consumed."""
    return checked.observe(
        counters, F.count(F.lit(1)).alias("lines"), F.count("reason").alias("rejected"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("events"))


def run_totals(counts: DataFrame) -> dict[str, int]:
    """Totals of a table with one row of counters per micro-batch; ``active_*`` are those of the last one."""
    names = [c for c in counts.columns if c != "batch"]
    total = lambda c: F.max_by(c, "batch") if c.startswith("active_") else F.sum(c)
    row = counts.agg(F.count(F.lit(1)).alias("batches"), *[total(c).alias(c) for c in names]).first()
    return {c: int(row[c]) for c in names} if row["batches"] else {}
