"""Idle sources of a stream, told by event time: a timer per source, set again with every micro-batch that holds it.

A source is idle when the watermark has passed its newest event by ``ttl_us``. Its timer then fires once: one row says when the source was last
seen, and its state is removed. A source that comes back starts anew. The watermark moves with the events alone, so a replay gives the same rows, and
a stream that is run over what is available ends by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dnsflow.streaming.windows import with_event_time

IDLE = "src_ip string, last_seen_us long, events long, watermark_us long"


class _LastSeen(StatefulProcessor):
    def __init__(self, ttl_us: int):
        self._ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "last_us long, events long, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, events, timer = self._seen.get() if self._seen.exists() else (-1, 0, None)
        for part in rows:
            last, events = max(last, int(part["last_us"].max())), events + int(part["events"].sum())
        if timer is not None:
            self._handle.deleteTimer(timer)
        # A timer lies in whole milliseconds after the last event, and not before the watermark, or it would never fire.
        timer = max(-(-(last + self._ttl_us) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self._handle.registerTimer(timer)
        self._seen.update((last, events, timer))
        yield pd.DataFrame(columns=["src_ip", "last_seen_us", "events", "watermark_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, events, _ = self._seen.get()
        self._seen.clear()
        yield pd.DataFrame({"src_ip": [key[0]], "last_seen_us": [last], "events": [events],
                            "watermark_us": [timerValues.getCurrentWatermarkInMs() * 1000]})

    def close(self) -> None:
        pass


def idle_stream(events: DataFrame, ttl_us: int = 300_000_000, delay: str = "10 seconds") -> DataFrame:
    """src_ip, last_seen_us, events and watermark_us of each source that has become idle; needs the RocksDB state store.

    A source's state is three numbers. Rows later than the watermark (newest event less ``delay``) are dropped and counted by Spark.
    """
    timed = with_event_time(events.select("src_ip", "ts_us"), delay)
    counted = timed.select("src_ip", "event_time", F.col("ts_us").alias("last_us"), F.lit(1).cast("long").alias("events"))
    return counted.groupBy("src_ip").transformWithStateInPandas(_LastSeen(ttl_us), IDLE, "Append", "EventTime")
