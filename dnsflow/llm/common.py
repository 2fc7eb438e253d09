"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.operators.scale import materialize

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_column_type(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """``schema`` with one more nullable column, which replaces one of the same name."""
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """The names, lengthened until none is among ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """Add ``next``, the next larger ``key`` (after the largest: the smallest); ``key`` is unique and not null.

    The ids are range-partitioned; ranges are chained by their first id, one row per range.
    """
    placed = materialize(ids.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    ranges = placed.groupBy("_range").agg(F.min(key).alias("_first"))
    order = Window.orderBy("_range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = ranges.select("_range", F.coalesce(
        F.lead("_first").over(order), F.first("_first").over(whole)).alias("_following"))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return placed.withColumn("_inside", inside).join(following, "_range").withColumn(
        "next", F.coalesce("_inside", "_following")).drop("_range", "_inside", "_following")
