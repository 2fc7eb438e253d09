"""Alert cooldown on a stream, with the last emission kept as state per (class, flow)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dnsflow.operators.cooldown import COOLDOWN_US, KEYS, in_range
from dnsflow.streaming.windows import time_mode


class _LastEmitted(StatefulProcessor):
    def __init__(self, cooldown_us: int, ttl_ms: int | None):
        self._cooldown_us, self._ttl_ms = cooldown_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "last_us long", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"]).reset_index(drop=True)
        t = in_range(batch["ts_us"].to_numpy(), self._cooldown_us)
        free = self._last.get()[0] + self._cooldown_us if self._last.exists() else int(t[0])
        kept = []
        while (i := int(t.searchsorted(free))) < len(t):
            kept.append(i)
            free = int(t[i]) + self._cooldown_us
        if kept:
            self._last.update((int(t[kept[-1]]),))
        yield batch.iloc[kept]

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, cooldown_us: int | None = COOLDOWN_US, ttl_ms: int | None = None) -> DataFrame:
    """Alerts of a stream that pass the cooldown. Needs the RocksDB state store.

    A flow that emits nothing for ``ttl_ms`` of processing time is forgotten; keep that longer than the cooldown, and ``None`` for a stream that is to end by itself.
    """
    if cooldown_us is None or cooldown_us <= 0:
        return alerts
    return alerts.groupBy(*KEYS).transformWithStateInPandas(
        _LastEmitted(cooldown_us, ttl_ms), alerts.schema, "Append", time_mode(ttl_ms))
