"""Approximate nearest neighbours along shifted Hilbert curves.

Each of ``curves`` orderings projects the vectors onto a few random orthonormal directions, shifts them by a random
offset and sorts them by their place on a Hilbert curve: range-partitioned by Spark, then numbered. A query looks at the rows
within a window of its place; rows are cut into blocks of ``BLOCK`` places, each query goes to the blocks its
window touches, and a block compares its queries with its rows in one matrix product. The best of each block are reranked by the exact distance and merged.

The window is a share of all rows, as distances in vectors without structure need: recall falls with a fixed window
as the table grows. Equal vectors count as one place that knows the smallest ids among them, so a vector that makes up a third of all rows costs
one. Vectors that are null, zero, hold null or non-finite components, or have another length than most take no part. Rows that share an id count
once, with the smallest vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize, running_totals

CURVES, DIRECTIONS, BITS = 16, 4, 15
WINDOW, LEAST_WINDOW = 0.045, 512   # places on either side: a share of all, and at least so many
BLOCK, QUERIES = 4096, 262_144      # places of a block, and places whose queries meet a block together
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the grid cells in ``cells`` (rows of coordinates below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:                      # undo the turns of the curve from the coarsest grid on
        low = bit - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):            # Gray code
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        fix ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def directions(size: int, curves: int = CURVES, dims: int = DIRECTIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (curves, size, dims) and shifts (curves, dims) of all curves."""
    rng = np.random.default_rng(seed)
    dims = min(dims, size)
    axes = np.stack([np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(curves)])
    return axes, rng.random((curves, dims))


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    usual = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.where(F.size("v") == (usual["n"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _places(classes: DataFrame, size: int, scale: float, curves: int, seed: int) -> DataFrame:
    """Rows (curve, key, class, v, members) of every class on every curve."""
    axes, shifts = directions(size, curves, seed=seed)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, size)
            for c in range(curves):
                spread = np.clip(0.5 + (x @ axes[c]) / (8 * scale), 0, 1 - 1e-9)
                cells = ((spread + shifts[c]) / 2 * (1 << BITS)).astype(np.int64)
                keys = hilbert_keys(cells, BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(keys), *batch.columns], ["curve", "key", *batch.schema.names])

    return classes.mapInArrow(run, "curve int, key long, " + ", ".join(f"{n} {t}" for n, t in classes.dtypes))


def _best(keep: int, size: int):
    """Nearest ``keep`` ids of each query in a block: (query, vec_id, score)."""
    def run(_, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            matrix = lambda t: np.array(pa.concat_arrays(t.column("v").chunks).flatten()).reshape(t.num_rows, size)
            x, classes, places = matrix(rows), np.array(rows.column("class")), np.array(rows.column("place"))
            members = rows.column("members").to_pylist()
            qs, q_classes = matrix(queries), np.array(queries.column("class"))
            lows, highs = np.array(queries.column("low")), np.array(queries.column("high"))
            norms = np.einsum("ij,ij->i", x, x)
            for start in range(0, len(qs), 256):
                q = qs[start:start + 256]
                near = norms[None] - 2 * (q @ x.T)
                outside = (places[None] < lows[start:start + 256, None]) | (places[None] > highs[start:start + 256, None])
                near[outside] = np.inf
                some = min(keep + 8, len(x))        # a margin for rounding in the product
                picked = np.argpartition(near, some - 1, axis=1)[:, :some]
                for i, cols in enumerate(picked):
                    cols = cols[np.isfinite(near[i, cols])]
                    exact = np.sqrt(((q[i] - x[cols]) ** 2).sum(axis=1))
                    found = sorted((d, m) for d, c in zip(exact.tolist(), cols.tolist()) for m in members[c])[:keep]
                    out[0].extend([int(q_classes[start + i])] * len(found))
                    out[1].extend(m for _, m in found)
                    out[2].extend(d for d, _ in found)
        return pa.table({"query": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
           window: float = WINDOW, least_window: int = LEAST_WINDOW, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``is_query`` (a condition on vec_id) selects, its own row left out.

    Returns query_id, rank, vec_id, score (Euclidean distance); ties go to the smaller vec_id. Fewer rows than ``k`` are all returned.
    """
    spark, rows = vectors.sparkSession, materialize(usable(vectors, vec_id, vector))
    schema = "query_id long, rank int, vec_id long, score double"
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("size"), F.percentile_approx(
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 0.5).alias("norm")).first()
    if not known["n"]:
        return spark.createDataFrame([], schema)
    size = known["size"]
    # Equal vectors form a class, named by its smallest id; k + 1 members are enough for any answer.
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = materialize(
        rows.withColumn("_row", smallest).where(F.col("_row") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("class", F.get("members", F.lit(0))))
    queries = materialize(rows.where(is_query).join(classes.select("v", "class"), "v").select(F.col("vec_id").alias("query_id"), "class"))
    asked = queries.select("class").distinct().withColumn("asked", F.lit(True))
    total = classes.count()
    reach = max(least_window, math.ceil(window * total))
    scale = (known["norm"] or 1.0) / math.sqrt(size)
    placed = _places(classes.join(asked, "class", "left"), size, scale, curves, seed)
    ranked = materialize(running_totals(placed.withColumn("_one", F.lit(1)), ["key", "class"], {"place": "_one"}, ["curve"]))
    block = lambda place: F.floor(place / BLOCK)
    group = lambda place: F.floor(place / QUERIES)
    low, high = F.col("place") - reach, F.col("place") + reach
    sent = ranked.where("asked").select(
        "curve", "class", "v", low.alias("low"), high.alias("high"), group(F.col("place")).alias("group"),
        F.explode(F.sequence(block(F.greatest(low, F.lit(0))), block(F.least(high, F.lit(total))))).alias("block"))
    first, last = block(F.col("place")) * BLOCK, block(F.col("place")) * BLOCK + BLOCK - 1
    held = ranked.select(
        "curve", "class", "v", "members", "place", block(F.col("place")).alias("block"),
        F.explode(F.sequence(group(F.greatest(first - reach, F.lit(0))), group(F.least(last + reach, F.lit(total))))).alias("group"))
    keys = ["curve", "block", "group"]
    found = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        _best(k + 1, size), "query long, vec_id long, score double")
    nearest = found.groupBy(F.col("query").alias("class"), "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("class").orderBy("score", "vec_id")
    short = nearest.withColumn("_row", F.row_number().over(best)).where(F.col("_row") <= k + 1).drop("_row")
    own = queries.join(short, "class").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
