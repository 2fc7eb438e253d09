"""Building blocks that keep a plan exact and balanced when one key holds much of the data.

* ``materialize``     cuts lineage with a table in the shared checkpoint folder; ``release`` deletes it before the job's end
* ``lookup_join``     broadcast behind a size check, salted shuffle join beyond it
* ``hash_rank``       exact row numbers in hash order, without one task per group
* ``running_totals``  exact running sums in value order, without one task per group
* ``dealt``           tasks in proportion to the rows
* ``order_statistics`` exact ranked values (percentiles, medians) on top of it
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_BYTES = 32 << 20  # of a lookup side's values as text; beyond it both sides are shuffled
HOT_ROWS = 1_000_000        # rows of one key from which its rows are salted
SALTS = 128

TASK_ROWS = 250_000         # rows a task where a table is dealt out by size

T = TypeVar("T")

_local_folder: str | None = None
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a session on one machine without it gets a folder of its own."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="dnsflow-")
    return _local_folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back.

    Later uses see the same rows even if executors are lost, read only the columns they
    need, and give the optimizer a real table size.
    """
    path = f"{_scratch.get() or checkpoint_folder(df.sparkSession) + '/dnsflow'}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def has_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, and have the driver drop the shuffle files of finished jobs.

    Spark removes shuffle files when its driver's garbage collector finds their jobs unused; a driver with much memory seldom collects. Frames
    that Python keeps in cycles hold theirs until it collects, too, and the last job's are held by its events until another job's follow.
    """
    for table in tables:
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            if "/dnsflow/" not in folder:
                raise ValueError(f"not a table of materialize: {folder}")
            remove_folder(spark, folder)
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables materialized inside are deleted at the end: write what is to stay elsewhere."""
    folder = f"{checkpoint_folder(spark)}/dnsflow/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove_folder(spark, folder)


def at_once(*steps: Callable[[], T]) -> list[T]:
    """Run independent driver steps side by side, so that their jobs share the cluster."""
    return side_by_side(steps, len(steps))


def side_by_side(steps: Sequence[Callable[[], T]], most: int) -> list[T]:
    """The same for many steps, ``most`` of them at a time; an error of one ends the run when those under way are done."""
    with ThreadPoolExecutor(max(1, most)) as pool:
        return [future.result() for future in [pool.submit(copy_context().run, step) for step in steps]]


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether all values of ``df``, written as text, take at most ``most`` bytes; every row is measured."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(16))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` (any size, any skew) with ``right`` (unique in ``on``).

    A right side of measured small size is broadcast. Otherwise ``left`` is written once, both sides are
    shuffled, and the rows of every left key with ``hot_rows`` rows or more are spread over ``salts`` sub-keys by
    the hash of the ``spread`` columns, while the matching right row is repeated per sub-key.
    """
    on = list(on)
    if fits_broadcast(right, broadcast_bytes):
        return left.join(F.broadcast(right), on, how)
    left = materialize(left)
    hot_keys = materialize(
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows)
        .select(*on, F.lit(True).alias("_hot")))
    if hot_keys.isEmpty():
        return left.join(right, on, how)
    sub_key = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salts))
    salted_left = (
        left.join(hot_keys, on, "left")
        .withColumn("_salt", F.when(F.col("_hot"), sub_key).otherwise(F.lit(0).cast("long")))
        .drop("_hot")
    )
    sub_keys = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    salted_right = (
        right.join(hot_keys, on, "left")
        .withColumn("_salt", F.explode(F.coalesce(sub_keys, F.array(F.lit(0).cast("long")))))
        .drop("_hot")
    )
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")


def hash_key(key: str | Column, seed: int | str) -> Column:
    """Portable pseudo-random order: hex MD5 of ``key:seed``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_rank(
    df: DataFrame, key: str, seed: int | str, group: Sequence[str] = (), rank: str = "rank", size: str | None = None,
    digits: int = 4, at_most: int | None = None,
) -> DataFrame:
    """Row number (from 1) of each row within ``group`` in the order of ``hash_key``.

    Rows are numbered inside blocks that share the first ``digits`` hex digits of the hash,
    so a group of any size is spread evenly over 16**digits blocks; the block sizes give
    the offsets. ``key`` must be unique within the group. ``at_most`` keeps the first ranks
    only, and blocks that lie behind them are dropped before any row is shuffled.
    """
    group = list(group)
    block = [*group, "_block"]
    hashed = df.withColumn("_hash", hash_key(key, seed)).withColumn("_block", F.substring("_hash", 1, digits))
    sizes = hashed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *block,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    inside = Window.partitionBy(*block).orderBy("_hash", key)
    if at_most is None:
        placed = hashed.join(offsets, block)
    else:
        placed = lookup_join(hashed, materialize(offsets.where(F.col("_before") < at_most)), block, "inner", [key])
    numbered = placed.withColumn("_row", F.row_number().over(inside))
    if at_most is not None:
        numbered = numbered.where(F.col("_before") + F.col("_row") <= at_most)
    extra = [F.col("_size").alias(size)] if size else []
    return numbered.select(*df.columns, (F.col("_before") + F.col("_row")).alias(rank), *extra)


def running_totals(
    df: DataFrame, order: Sequence[str], sums: dict[str, str], group: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` in ascending ``order``.

    The rows are range-partitioned by (group, order) as for a sort, each range becomes a
    block, and block totals carry over to later blocks. ``order`` must be unique within the
    group: pre-aggregate ties first.
    """
    group, order = list(group), list(order)
    placed = materialize(
        df.repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id())
    )
    block = [*group, "_block"]
    totals = placed.groupBy(*block).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *block, *[F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_c_{o}") for o in sums]
    )
    inside = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.select("*", *[F.sum(c).over(inside).alias(f"_s_{o}") for o, c in sums.items()]).join(carried, block)
    return out.select(*df.columns, *[(F.col(f"_s_{o}") + F.col(f"_c_{o}")).alias(o) for o in sums])


def order_statistics(
    df: DataFrame, value: str, positions: dict[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Values at 0-based sorted ``positions`` (expressions over the group size ``n``), per group.

    Equal values are counted before the shuffle, then located by their running count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_times"))
    return order_statistics_of_counts(counted, value, "_times", positions, group)


def order_statistics_of_counts(
    counts: DataFrame, value: str, times: str, positions: dict[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """``order_statistics`` of values that are already counted; counts of the same value, from several batches say, add up."""
    group = list(group)
    counted = materialize(counts.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(times).cast("long").alias("_times")))
    placed = running_totals(counted, [value], {"_upto": "_times"}, group)
    sizes = counted.groupBy(*group).agg(F.sum("_times").alias("n"))
    if group:
        located = placed.join(sizes, group)
    else:
        located = placed.withColumn("n", F.lit(sizes.first()["n"] or 0).cast("long"))
    covers = lambda at: (F.col("_upto") > at) & (F.col("_upto") - F.col("_times") <= at)
    return located.groupBy(*group).agg(
        *[F.max(F.when(covers(at), F.col(value))).alias(name) for name, at in positions.items()],
        F.max("n").alias("n"),
    )


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, put together by ``keys`` in as many tasks as its size asks for, where the session's shuffles have fewer.

    Windows and sums over ``keys`` and more columns that follow stay in these tasks.
    """
    tasks = 1 + rows // task_rows
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
