"""Cooldown: per (class, flow) emit an alert only when the last emitted one is old enough.

The rule is a chain: what is emitted depends on the previous emission. To let one busy flow use
many tasks, its time line is cut into chunks of many cooldowns:

1. each chunk reports, for every possible first emission, when the flow is free again after
   the chunk (an entering chain can only start within the first cooldown of the chunk);
2. these short tables are chained per flow to get the entry state of every chunk;
3. each chunk emits its alerts from its entry state.

All three passes read sorted partitions as a stream and keep only the state of one flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.scale import lookup_join, materialize

COOLDOWN_US = 30_000_000
CHUNK_COOLDOWNS = 64
KEYS = ("threat_class", "flow_id")
_FREE, _MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _key(columns: tuple[str, ...]) -> Column:
    """One unambiguous string for the key columns."""
    return F.concat(*[F.concat(F.char_length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns])


def in_range(times: np.ndarray, cooldown_us: int) -> np.ndarray:
    """Times to which the cooldown can be added; what lies beyond counts as one last moment."""
    return np.minimum(times, _MAX - cooldown_us - 1)


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
    """Consecutive rows with the same (key, chunk): ``(group, from, to)``."""
    key, chunk = pdf["key"].to_numpy(), pdf["chunk"].to_numpy()
    edges = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
    bounds = [0, *edges.tolist(), len(pdf)]
    for lo, hi in zip(bounds, bounds[1:]):
        yield (key[lo], int(chunk[lo])), lo, hi


def _exits(cooldown_us: int):
    """Pass 1: (first emission at ``start``) -> ``free`` again, per chunk."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, free = None, np.empty(0, np.int64), np.empty(0, np.int64)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            times, done = in_range(pdf["ts_us"].to_numpy(), cooldown_us), []
            for group, lo, hi in _runs(pdf):   # the last run may go on in the next batch
                if group != current:
                    if current is not None:
                        done.append((current, start, free))
                    current, start, free = group, np.empty(0, np.int64), np.empty(0, np.int64)
                t = times[lo:hi]
                first_cooldown = min((group[1] * CHUNK_COOLDOWNS + 1) * cooldown_us, _MAX)
                n = int(t.searchsorted(first_cooldown))
                if n < len(t) and not (len(start) and start[-1] >= first_cooldown):
                    n += 1   # the first alert after it serves chains that skip all of the first cooldown
                if n:
                    start, free = np.concatenate([start, t[:n]]), np.concatenate([free, t[:n]])
                while len(free) and (due := free <= t[-1]).any():
                    free[due] = t[t.searchsorted(free[due])] + cooldown_us
            yield _table(done)
        if current is not None:
            yield _table([(current, start, free)])
    return run


def _table(done: list[tuple]) -> pd.DataFrame:
    """Exit tables of finished chunks; of adjacent equal exits the latest start stands for all."""
    sizes = [len(start) for _, start, _ in done]
    column = lambda values, dtype: np.concatenate([np.empty(0, dtype), *values])
    out = pd.DataFrame({
        "key": np.repeat(np.array([g[0] for g, _, _ in done], object), sizes),
        "chunk": np.repeat(np.array([g[1] for g, _, _ in done], np.int64), sizes),
        "start": column([s for _, s, _ in done], np.int64), "free": column([f for _, _, f in done], np.int64)})
    later = out.shift(-1)
    return out[(out["key"] != later["key"]) | (out["chunk"] != later["chunk"]) | (out["free"] != later["free"])]


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 2: when each chunk's flow is free at entry."""
    key, chunk, free, settled = None, None, _FREE, False
    for pdf in batches:
        out = []
        for k, c, start, after in zip(pdf["key"], pdf["chunk"], pdf["start"], pdf["free"]):
            if k != key:
                key, chunk, free = k, None, _FREE
            if c != chunk:
                chunk, settled = c, False
                out.append((k, c, free))
            if not settled and start >= free:
                free, settled = after, True
        yield pd.DataFrame(out, columns=["key", "chunk", "free"])


def _emit(cooldown_us: int):
    """Pass 3: alerts emitted by each chunk from its entry state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, _FREE
        for pdf in batches:
            if len(pdf) == 0:
                continue
            times, entry, kept = in_range(pdf["ts_us"].to_numpy(), cooldown_us), pdf["free"].to_numpy(), []
            for group, lo, hi in _runs(pdf):
                if group != current:
                    current, free = group, int(entry[lo])
                t = times[lo:hi]
                while (i := int(t.searchsorted(free))) < len(t):
                    kept.append(lo + i)
                    free = int(t[i]) + cooldown_us
            yield pdf.iloc[kept][["key", "ts_us", "seq"]]
    return run


def apply_cooldown(
    alerts: DataFrame,
    cooldown_us: int | None = COOLDOWN_US,
    keys: tuple[str, ...] = KEYS,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Alerts that pass the cooldown, in ``(ts_us, seq)`` order per key; ``None`` switches it off.

    ``previous`` (key columns and ``last_us``) holds emissions before this table: what falls into
    their cooldown is dropped first. ``alerts`` is read twice: pass a materialized table.
    """
    if cooldown_us is None or cooldown_us <= 0:
        return alerts
    if previous is not None:
        known = lookup_join(alerts, previous.select(*keys, "last_us"), keys, "left", spread=["seq"])
        alerts = materialize(known.where(
            F.col("last_us").isNull() | (F.col("ts_us") - F.col("last_us") >= cooldown_us)).drop("last_us"))
    chunk = F.expr(f"ts_us div {cooldown_us * CHUNK_COOLDOWNS}L")
    points = materialize(
        alerts.groupBy(_key(keys).alias("key"), "ts_us").agg(F.min("seq").alias("seq")).withColumn("chunk", chunk))
    exits = points.select("key", "chunk", "ts_us").repartition("key", "chunk").sortWithinPartitions(
        "key", "chunk", "ts_us").mapInPandas(_exits(cooldown_us), "key string, chunk long, start long, free long")
    entries = exits.repartition("key").sortWithinPartitions("key", "chunk", "start").mapInPandas(
        _entries, "key string, chunk long, free long")
    emitted = points.join(entries, ["key", "chunk"]).select("key", "chunk", "ts_us", "seq", "free").repartition(
        "key", "chunk").sortWithinPartitions("key", "chunk", "ts_us").mapInPandas(
        _emit(cooldown_us), "key string, ts_us long, seq long")
    return alerts.withColumn("key", _key(keys)).join(emitted, ["key", "ts_us", "seq"], "left_semi").select(
        *alerts.columns)


def last_emitted(emitted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """State to pass as ``previous`` to a later run."""
    return emitted.groupBy(*keys).agg(F.max("ts_us").alias("last_us"))
