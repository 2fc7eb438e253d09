"""Documents in shards of near equal bytes, copies of a text never apart: minimax partition of an ordered row of text groups.

A group is all documents with the same text; its size is that of all its copies. The groups stand in one order, shards are consecutive parts
of it, and the smallest capacity is sought by which a greedy cut needs no more shards than there are. A search step tries many capacities at
once: one job a cut finds, for all of them, the last group that still fits (``_reach``), reading only the stretch of the table where those
cuts can lie. The driver holds ``TRIES`` numbers a cut.

Order: groups are spread by the digest of their text, so that a shard is a sample of the corpus. Groups above 1/64 of a shard, at most 64 a shard, are
dealt first, the largest to the emptiest shard, and the others fill up what is left by ranges of the digest; without this, a group of nearly
a shard's size somewhere in the order would leave a gap before it. A group larger than the mean of what is left gets a shard of its own.

Slots number the rows of a shard from 0 in the order of (group, doc_id); rows are range-partitioned by it, so a group of any size is spread.

Null texts have no bytes and form a group with the empty ones; doc_id may be null or repeat: each row gets its own slot, and rows alike in doc_id
and text are told apart by their place in the input. Empty tables give no rows. Extra columns stay out of ``place`` and stay in ``write_shards``,
but for those named like its own (shard, slot), which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize, running_totals

HEAVY = 64      # a group is dealt by itself if it takes more than this part of a shard
TRIES = 4096    # capacities tried at once


def _group(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _reach(ends: DataFrame, limits: list[int], least: int) -> list[int]:
    """For each ascending limit the largest ``upto`` that does not exceed it; ``least`` where there is none. Read: those above ``least`` only."""
    bounds = np.array(limits, np.int64)

    def run(batches):
        last = np.full(len(bounds), -1, np.int64)
        for batch in batches:
            upto = np.sort(batch.column("upto").to_numpy())
            at = np.searchsorted(upto, bounds, "right")
            last = np.maximum(last, np.where(at > 0, upto[np.maximum(at - 1, 0)] if len(upto) else -1, -1))
        # Within one task a limit above its last row adds nothing to the limit below.
        new = np.flatnonzero(np.diff(last, prepend=-1) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array(last[new], pa.int64())], ["place", "upto"])

    window = ends.where((F.col("upto") > least) & (F.col("upto") <= int(bounds[-1]))).select("upto")
    found = dict(window.mapInArrow(run, "place long, upto long").groupBy("place").agg(F.max("upto")).collect())
    out, best = [], least
    for place in range(len(limits)):
        best = max(best, found.get(place, least))
        out.append(best)
    return out


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, tries: int = TRIES) -> tuple[int, list[int]]:
    """The smallest capacity and the ends of the shards, as values of ``upto``: running sums of ordered group sizes, the last is ``total``.

    Shards from the first on take as many groups as fit; the last cuts repeat ``total`` if fewer shards are enough.
    """
    low, high, cuts = max(largest, -(-total // shards)), -(-total // shards) + largest, []
    while True:
        step = max(1, -(-(high - low + 1) // tries))
        capacities = list(range(low, high, step)) + [high]
        at, chains = [0] * len(capacities), []
        for _ in range(shards):
            # A larger capacity never cuts earlier, so the limits ascend.
            at = _reach(ends, [a + c for a, c in zip(at, capacities)], min(at))
            chains.append(at)
            if min(at) == total:
                break
        first = next(i for i, end in enumerate(at) if end == total)
        cuts = [chain[first] for chain in chains] + [total] * (shards - len(chains))
        if step == 1 or first == 0:
            return capacities[first], cuts
        low, high = capacities[first - 1] + 1, capacities[first]


def _dealt(heavy: list[tuple[str, int]], light: int, shards: int) -> tuple[list[list[str]], list[float]]:
    """The heavy groups of each shard, and what share of the light bytes each is to take: the fullest shards first."""
    loads, held = [0] * shards, [[] for _ in range(shards)]
    for digest, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        least = min(range(shards), key=lambda s: (loads[s], s))
        loads[least] += size
        held[least].append(digest)
    order = sorted(range(shards), key=lambda s: (-loads[s], s))
    loads, held = [loads[s] for s in order], [held[s] for s in order]
    # The level up to which the light bytes fill the shards, the emptiest first.
    level = next((light + sum(loads[s:])) / (shards - s) for s in range(shards)
                 if s == shards - 1 or (light + sum(loads[s:])) / (shards - s) >= loads[s])
    return held, [max(0.0, level - load) / light if light else 0.0 for load in loads]


def _in_order(rows: DataFrame, own: list[str], held: list[list[str]], shares: list[float]) -> DataFrame:
    """Add ``at``, the sort key of a group: those with a shard of their own, then shard by shard its heavy groups and the light ones by digest."""
    fixed = [(d, f"{0:06d}{i:06d}") for i, d in enumerate(own)]
    fixed += [(d, f"{s + 1:06d}{i:06d}") for s, digests in enumerate(held) for i, d in enumerate(digests)]
    known = rows.sparkSession.createDataFrame(fixed, "digest string, fixed string")     # HEAVY + 1 rows a shard at most
    upto = [f"{min(int(share * 2**64), 2**64 - 1):016x}" for share in np.cumsum(shares[:-1]).tolist()]
    first = F.substring("digest", 1, 16)
    light = sum((F.when(first >= bound, 1).otherwise(0) for bound in upto), F.lit(1)).cast("string")
    place = F.coalesce("fixed", F.concat(F.lpad(light, 6, "0"), F.lit("999999")))
    return rows.join(F.broadcast(known), "digest", "left").withColumn("at", F.concat(place, F.lit(":"), "digest")).drop("fixed")


def place(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot (and ``row``, if that column is given): the shard of every row and its place in it."""
    content = F.coalesce(F.col(text), F.lit(""))
    own = materialize(docs.select(
        F.col(key).alias("key"), (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
        _group(content).alias("digest"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row")))
    groups = materialize(own.groupBy("digest").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = [(d, b) for d, b in groups.where(F.col("bytes") * shards * HEAVY > total).select("digest", "bytes").collect()]
    alone, rest, left = [], total, shards
    for digest, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        if left == 1 or size * left <= rest:
            break
        alone.append((digest, size))
        rest, left = rest - size, left - 1
    apart = {d for d, _ in alone}
    heavy = [g for g in heavy if g[0] not in apart]
    held, shares = _dealt(heavy, rest - sum(b for _, b in heavy), left)
    in_order = lambda rows: _in_order(rows, [d for d, _ in alone], held, shares)
    ends = materialize(running_totals(in_order(groups), ["at"], {"upto": "bytes"}))
    base = total - rest
    largest = groups.where(~F.col("digest").isin(sorted(apart))).agg(F.max("bytes")).first()[0] if rest else 0
    cuts = []
    if rest:
        shifted = ends.where(F.col("upto") > base).select("at", (F.col("upto") - base).alias("upto"))
        cuts = [c + base for c in minimax_cuts(shifted, rest, largest, left)[1]]
    bounds = np.cumsum([b for _, b in alone], dtype=np.int64).tolist() + cuts
    last = {u: k for u, k in ends.where(F.col("upto").isin(sorted(set(bounds)))).select("upto", "at").collect()}
    shard_ends = [last[b] for b in bounds]
    # A row's shard is the number of shard ends before its group.
    shard = sum((F.when(F.col("at") > end, 1).otherwise(0) for end in shard_ends[:-1]), F.lit(0)).cast("int")
    rows = in_order(own).withColumn("one", F.lit(1).cast("long"))
    numbered = running_totals(rows, ["at", "key", "row"], {"upto": "one"}).withColumn("shard", shard)
    counts = dict(rows.groupBy(shard.alias("shard")).count().collect())
    starts = np.cumsum([0, *[counts.get(s, 0) for s in range(shards)]]).tolist()
    first = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    kept = ["key", "size", "text_crc32", "shard", (F.col("upto") - 1 - first).alias("slot")] + (["row"] if row else [])
    return numbered.select(*kept)


def write_shards(docs: DataFrame, folder: str, shards: int = 16, text: str = "text", key: str = "doc_id") -> None:
    """Write ``docs`` with ``shard`` and ``slot``: a folder per shard, its files in the order of the slots."""
    plain = docs.drop("shard", "slot", "_row")
    own = materialize(plain.withColumn("_row", F.monotonically_increasing_id()))
    placed = place(own, shards, text, key, row="_row").select(F.col("row").alias("_row"), "shard", "slot")
    whole = own.join(placed, "_row").drop("_row")
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
