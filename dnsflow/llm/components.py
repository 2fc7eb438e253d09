"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step takes minima by node with map-side combining and joins them back, so a node with many edges is split by the adaptive skew join; the
number of rounds grows with the logarithm of the longest chain. Nothing but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node that has an edge; the label is the smallest node of the component.

    ``edges``: u, v (long, not null). Loops and repeated edges change nothing; no edges give no rows.
    """
    star = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or not now[0]:
            break
        before = now
        star = materialize(_small_star(_large_star(star).distinct()).distinct())
    return star.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
