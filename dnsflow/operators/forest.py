"""Isolation forest: trees grown level by level with DataFrame functions, scored in Arrow batches.

Each tree sees the rows with the smallest hashes for that tree, so the model does not depend
on partitioning. The model itself is a node table of at most 511 rows per tree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dnsflow.operators.evaluation import quantile
from dnsflow.operators.scale import materialize
from dnsflow.schemas import WINDOW_FEATURES

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth int, size int"
_ROWS_AT_ONCE = 512     # rows times trees that fit a core's cache


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _draw(*parts: Column | int | str) -> Column:
    """Uniform number in [0, 1) from an MD5 of the parts; any engine with MD5 can repeat it."""
    text = F.concat_ws(":", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def grow_trees(sampled: DataFrame, features: Sequence[str], sample: int, seed: int = 42) -> DataFrame:
    """Node table of one tree per ``tree`` in ``sampled`` (tree, features); nodes are numbered as in a heap, the children of n are 2n+1 and 2n+2.

    All trees grow by one level at a time. Smallest and largest values per tree and node are windows over rows that a single shuffle has put together by
    tree, at most ``sample`` of them; a row notes the nodes it passes. Which feature splits a node, and where between its extremes,
    are draws by (seed, tree, node), so the trees depend on the rows alone.
    """
    height, width = math.ceil(math.log2(max(sample, 2))), len(features)
    rows = sampled.select(
        F.col("tree").cast("int").alias("tree"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).repartition("tree")
    rows = rows.withColumns({"node": F.lit(0), "open": F.lit(True), "path": F.expr(
        "cast(array() as array<struct<node: int, feature: int, threshold: double, left: int, right: int, depth: int>>)")})
    together = Window.partitionBy("tree", "node")
    for depth in range(height + 1):
        value = lambda f: F.get("x", F.lit(f))
        rows = rows.withColumns({
            "low": F.array(*[F.min(value(f)).over(together) for f in range(width)]),
            "high": F.array(*[F.max(value(f)).over(together) for f in range(width)])})
        can = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.get("high", f) > F.get("low", f))
        rows = rows.withColumns({"can": can, "u": _draw(seed, F.col("tree"), F.col("node"), 1), "v": _draw(seed, F.col("tree"), F.col("node"), 2)})
        split = F.col("open") & (F.size("can") > 0) if depth < height else F.lit(False)
        rows = rows.withColumn("f", F.get("can", F.floor(F.col("u") * F.size("can")).cast("int"))).withColumn("split", split)
        low, high = F.get("low", F.col("f")), F.get("high", F.col("f"))
        cut = low + F.col("v") * (high - low)
        rows = rows.withColumn("cut", F.when(cut < high, cut).otherwise(low))
        child = lambda right: (F.col("node") * 2 + 1 + right).cast("int")
        step = F.struct(
            "node", F.when(F.col("split"), F.col("f")).otherwise(0).alias("feature"),
            F.when(F.col("split"), F.col("cut")).otherwise(float("inf")).alias("threshold"),
            F.when(F.col("split"), child(0)).otherwise(F.col("node")).alias("left"),
            F.when(F.col("split"), child(1)).otherwise(F.col("node")).alias("right"), F.lit(depth).alias("depth"))
        goes_right = (F.get("x", F.col("f")) > F.col("cut")).cast("int")
        rows = rows.select(
            "tree", "x", F.when(F.col("split"), child(goes_right)).otherwise(F.col("node")).alias("node"), F.col("split").alias("open"),
            F.when(F.col("open"), F.array_append("path", step)).otherwise(F.col("path")).alias("path"))
    nodes = rows.select("tree", F.explode("path").alias("n")).groupBy("tree", "n").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return nodes.select("tree", "n.*", "size")


@dataclass
class Forest:
    nodes: DataFrame
    sample: int
    offset: float
    features: tuple[str, ...] = WINDOW_FEATURES

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        spark.createDataFrame(
            [(self.sample, self.offset, list(self.features))], "sample int, offset double, features array<string>"
        ).write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        params = spark.read.parquet(f"{path}/params").first()
        return Forest(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), params["sample"], params["offset"],
                      tuple(params["features"]))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``decision``: negative for outliers."""
        return df.withColumn("decision", self._score_samples() - F.lit(self.offset))

    def _score_samples(self):
        """Column of ``-2 ** (-mean path / expected path)``; the trees walk a batch level by level."""
        table = self.nodes.orderBy("tree", "node").toPandas()
        trees, width = int(table["tree"].max()) + 1, int(table["node"].max()) + 1

        def grid(values, dtype):
            out = np.zeros((trees, width), dtype)
            out[table["tree"], table["node"]] = values
            return out.ravel()

        start = np.arange(trees) * width
        offset_of = table["tree"].to_numpy() * width
        feature, threshold = grid(table["feature"], np.intp), grid(table["threshold"], float)
        # Children of node n stand at 2n (right) and 2n + 1 (left).
        children = np.stack([grid(table["right"] + offset_of, np.intp), grid(table["left"] + offset_of, np.intp)], axis=1).ravel()
        path = grid(table["depth"] + average_path(table["size"]), float)
        levels = int(table["depth"].max())
        expected = float(average_path(self.sample))

        @F.pandas_udf("double")
        def score_samples(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            out = np.empty(len(x))
            for at in range(0, len(x), _ROWS_AT_ONCE):
                part = x[at:at + _ROWS_AT_ONCE]
                values, first = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
                node = np.broadcast_to(start, (len(part), trees))
                for _ in range(levels):
                    node = children.take(2 * node + (values.take(first + feature.take(node)) <= threshold.take(node)))
                out[at:at + len(part)] = -np.exp2(-path.take(node).mean(axis=1) / max(expected, 1e-12))
            return pd.Series(out)

        return score_samples(*[F.col(f).cast("double") for f in self.features])


def train_forest(
    normal: DataFrame, key: str, features: Sequence[str] = WINDOW_FEATURES, n_trees: int = 100, sample: int = 256,
    contamination: float = 0.02, seed: int = 42,
) -> Forest:
    """Fit on normal windows only; ``key`` is unique per row.

    Each tree takes the ``sample`` rows with the smallest hash of (tree, key). A bound on the
    hash, far above what is needed, drops the other rows before they are repeated per tree.
    """
    n = normal.count()
    sample = min(sample, n)
    share = min(1.0, (sample + 10 * math.sqrt(sample) + 10) / max(n, 1))
    bound = min(int(-(2 ** 63) + share * 2 ** 64), 2 ** 63 - 1)
    hash_of = lambda tree: F.xxhash64(F.lit(seed), tree, F.col(key))
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if share < 1.0:
        trees = F.filter(trees, lambda tree: hash_of(tree) <= F.lit(bound))
    drawn = normal.select(key, *[F.col(f).cast("double").alias(f) for f in features], F.explode(trees).alias("tree"))
    by_tree = Window.partitionBy("tree").orderBy("_hash", key)
    sampled = drawn.withColumn("_hash", hash_of(F.col("tree"))).withColumn(
        "row", F.row_number().over(by_tree)).where(F.col("row") <= sample)
    nodes = materialize(grow_trees(sampled, features, sample, seed))
    forest = Forest(nodes, sample, 0.0, tuple(features))
    offset = quantile(forest.score(normal).select("decision"), "decision", contamination).first()["quantile"]
    return Forest(nodes, sample, float(offset), tuple(features))
