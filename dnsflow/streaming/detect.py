"""Streaming detection: log files -> alerts, with quarantine and counters.

One query reads and parses each line once. A micro-batch runs the batch operators on its events together with stored
state, so busy sources and flows split as they do in a batch. All that a batch writes stands in folders of its own number, so a
repeated batch replaces itself and starts from the same state; intermediate tables go when the batch is done.

Windows are carried as aggregates, not as events: counters per source, bucket and record type, and the names seen per source and bucket
(``windows.Carried``). A micro-batch adds its own events to them, so what is stored grows with sources, buckets, types and names, and not with
the events in a window. An event is late when its source has reached a time more than ``late_us`` after it in an earlier micro-batch: late events are
written aside and counted, and take no part in windows (names need no order and are scored as always). Windows of the others are complete, as buckets
stay for ``late_us`` and the reach of a window.

State is kept per key, so a source with a wrong clock harms only itself: its buckets are cut by its own newest time. A key expires when the stream's
clock has moved on by ``idle_us`` since the key was last seen, or by the reach of its windows or cooldown if that is longer. That clock is the median of
the newest times of all known keys: one key can't move it. A micro-batch may span any time, so a key counts as seen at its own newest time if that is
later, up to a high quantile of the batch's times. Of a flow the newest alert is kept, and the newest ones not far ahead of the clock and of that
quantile; the cooldown starts from the newest that is not far ahead of the flow's next alert.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from dnsflow.operators.alerts import public_columns
from dnsflow.operators.cooldown import KEYS, apply_cooldown
from dnsflow.operators.evaluation import nearest_rank_of_counts
from dnsflow.operators.scale import at_once, has_folder, lookup_join, materialize, remove_folder, scratch
from dnsflow.operators.windows import Carried, window_features
from dnsflow.plans.detect import Detector, name_alerts, window_alerts
from dnsflow.schemas import EVENT
from dnsflow.sources.events import accepted, check_events, number_lines, rejected, stream_lines, with_arrival_number
from dnsflow.sources.sinks import run_totals

IDLE_US = 300_000_000
HIGH = 0.9                  # share of a batch's events up to whose time a key's own time is trusted
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SOURCES = "src_ip string, at long, seen_us long"
TYPES = "src_ip string, bucket long, qtype string, n long, len double, nx long"
NAMES = "src_ip string, domain string, bucket long"
LAST = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS],
                     T.StructField("last_us", T.LongType()), T.StructField("seen_us", T.LongType())])
COUNTS = "batch long, lines long, rejected long, events long, alerts long, active_sources long, expired_sources long, " \
         "active_flows long, expired_flows long"
BATCH_COUNTS = f"{COUNTS}, late long, state_rows long, ms long"


@dataclass
class Folders:
    """Where a run keeps its tables and checkpoint, and the counters of its last call."""

    base: str
    run_counts: dict[str, int] = field(default_factory=dict)

    @property
    def rejects(self) -> str:
        return f"{self.base}/rejects"

    @property
    def late(self) -> str:
        return f"{self.base}/late"

    @property
    def last_alerts(self) -> str:
        return f"{self.base}/last_alerts"

    @property
    def history(self) -> str:
        """Carried windows: folders ``sources``, ``types`` and ``names`` of each batch."""
        return f"{self.base}/history"

    @property
    def alerts(self) -> str:
        return f"{self.base}/alerts"

    @property
    def counts(self) -> str:
        return f"{self.base}/counts"

    @property
    def checkpoint(self) -> str:
        return f"{self.base}/checkpoint"


def use_rocksdb(spark: SparkSession) -> None:
    """State store that the operators with keyed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _of(batch: int, path: str) -> str:
    return f"{path}/batch={batch}"


def _state(spark: SparkSession, path: str, batch: int, schema: T.StructType | str, part: str = "") -> DataFrame:
    """State after the batch before; empty for the first one."""
    return spark.read.schema(schema).parquet(_of(batch - 1, path) + part) if batch else spark.createDataFrame([], schema)


def _clock(newest: DataFrame) -> int:
    """Median of the newest times of all keys (the lower one of two)."""
    return newest.agg(F.percentile_approx("at", 0.5)).first()[0] or 0


def _kept(keys: list[str], seen: DataFrame, clock: int, high: int, idle_us: int) -> tuple[DataFrame, int, int]:
    """Keys that stay (with ``seen_us``, the clock when last seen), their number and that of the expired ones.

    ``seen``: the keys with ``at``, their newest time, ``was``, the clock stored for them, and ``now``, whether this batch holds them. ``high``: up to
    where a time counts that is later than the clock.
    """
    at = F.greatest(F.lit(clock), F.least("at", F.lit(high)))
    known = materialize(seen.groupBy(*keys).agg(F.max(F.when(F.col("now"), at).otherwise(F.col("was"))).alias("seen_us")))
    stays = F.lit(clock) - F.col("seen_us") <= idle_us
    n, live = known.agg(F.count(F.lit(1)), F.count(F.when(stays, 1))).first()
    return known.where(stays), live, n - live


def mark_late(events: DataFrame, newest: DataFrame, late_us: int) -> DataFrame:
    """Add ``late``: whether the event's source had reached (``newest``: src_ip, at) a time more than ``late_us`` after it."""
    known = lookup_join(events, newest.select("src_ip", "at"), ["src_ip"], "left", spread=["seq"])
    return known.withColumn("late", F.coalesce(F.col("at") - F.col("ts_us") > late_us, F.lit(False))).select(*events.columns, "late")


def process_batch(lines: DataFrame, batch: int, folders: Folders, detector: Detector, idle_us: int = IDLE_US,
                  late_us: int | None = None) -> None:
    """One micro-batch: rejects, late events, alerts after the cooldown, state and counters, each in the batch's own folder.

    ``lines`` without file and line number events by their content where they carry no ``seq``. ``late_us``: by default the reach of a window.
    """
    spark, began = lines.sparkSession, time.perf_counter()
    write = lambda df, path, part="": df.write.mode("overwrite").parquet(_of(batch, path) + part)
    reach = detector.bucket_us * detector.n_buckets
    late_us = reach if late_us is None else late_us
    with scratch(spark):
        if "block" in lines.columns:
            lines = number_lines(lines)
        place = [c for c in ("file", "line") if c in lines.columns]
        checked = materialize(check_events(lines).withColumn("event_seq", F.coalesce("event_seq", F.xxhash64(*place, "value"))))
        write(rejected(checked), folders.rejects)
        before = _state(spark, folders.history, batch, SOURCES, "/sources")
        past = Carried(_state(spark, folders.history, batch, TYPES, "/types"), _state(spark, folders.history, batch, NAMES, "/names"))
        # ``seq`` numbers the batch in time order; ``id`` is the event's own number, which alerts carry.
        arrived = with_arrival_number(accepted(checked).withColumn("id", F.col("seq")))
        arrived = materialize(mark_late(arrived, before, late_us))
        new = arrived.withColumn("seq", F.col("id")).select(*EVENT.fieldNames())
        write(arrived.where("late").withColumn("seq", F.col("id")).select(*EVENT.fieldNames()), folders.late)
        on_time = arrived.where("not late")

        def from_windows() -> DataFrame:
            features = window_features(on_time.select(*EVENT.fieldNames()), detector.bucket_us, detector.n_buckets, past=past)
            enough = features.where(F.col("query_rate") >= detector.min_queries).join(on_time.select("seq", "id"), "seq")
            return window_alerts(enough.withColumn("seq", F.col("id")).drop("id"), detector)

        by_name, by_window = at_once(lambda: materialize(name_alerts(new, detector)), lambda: materialize(from_windows()))
        raw = by_name.unionByName(by_window)

        previous = _state(spark, folders.last_alerts, batch, LAST)
        memory = max(detector.cooldown_us or 0, idle_us)
        starts = raw.groupBy(*KEYS).agg(F.min("ts_us").alias("start"))
        last = materialize(previous.join(starts, list(KEYS)).where(F.col("last_us") - F.col("start") <= memory).groupBy(*KEYS).agg(
            F.max("last_us").alias("last_us")))
        emitted = materialize(apply_cooldown(raw, detector.cooldown_us, previous=last))
        public_columns(emitted).write.mode("overwrite").json(_of(batch, folders.alerts))

        # Sources: the buckets that windows of events which are not late can reach.
        newest = materialize(
            arrived.select("src_ip", F.col("ts_us").alias("at"), F.lit(True).alias("now"), F.lit(None).cast("long").alias("was"))
            .unionByName(before.select("src_ip", "at", F.lit(False).alias("now"), F.col("seen_us").alias("was")))
            .groupBy("src_ip").agg(F.max("at").alias("at"), F.max("now").alias("now"), F.max("was").alias("was")))
        high = new.agg(F.percentile_approx("ts_us", HIGH)).first()[0] or 0
        sources, live, gone = _kept(["src_ip"], newest, _clock(newest), high, max(idle_us, reach))
        stay = materialize(newest.select("src_ip", "at").join(sources, "src_ip"))
        oldest = F.expr(f"(at - {late_us}L) div {detector.bucket_us}L") - detector.n_buckets
        carried = past.plus(on_time, detector.bucket_us).since(stay.select("src_ip", oldest.alias("oldest")))
        write(stay.select("src_ip", "at", "seen_us"), folders.history, "/sources")
        write(carried.types.select("src_ip", "bucket", "qtype", "n", "len", "nx"), folders.history, "/types")
        write(carried.names.select("src_ip", "domain", "bucket"), folders.history, "/names")
        stored = sum(_state(spark, folders.history, batch + 1, schema, part).count()
                     for schema, part in ((SOURCES, "/sources"), (TYPES, "/types"), (NAMES, "/names")))

        # Flows: the last emission, which the cooldown starts from. One that lies far ahead doesn't silence the flow: those before it stay too.
        emissions = materialize(
            emitted.select(*KEYS, F.col("ts_us").alias("at"), F.lit(True).alias("now"), F.lit(None).cast("long").alias("was"))
            .unionByName(previous.select(*KEYS, F.col("last_us").alias("at"), F.lit(False).alias("now"), F.col("seen_us").alias("was"))))
        clock = _clock(emissions.groupBy(*KEYS).agg(F.max("at").alias("at")))
        upto = lambda time: F.max(F.when(F.col("at") - time <= memory, F.col("at")))
        flows = emissions.groupBy(*KEYS).agg(
            F.array(upto(clock), upto(high), F.max("at")).alias("ats"), F.max("now").alias("now"), F.max("was").alias("was"))
        flows = materialize(flows.withColumn("at", F.explode(F.array_distinct(F.array_compact("ats")))).drop("ats"))
        kept, live_flows, gone_flows = _kept(list(KEYS), flows, clock, high, memory)
        write(flows.select(*KEYS, F.col("at").alias("last_us")).join(kept, list(KEYS)).select(*LAST.fieldNames()), folders.last_alerts)

        n, bad = checked.agg(F.count(F.lit(1)), F.count("reason")).first()
        row = (batch, n, bad, n - bad, emitted.count(), live, gone, live_flows, gone_flows, arrived.where("late").count(), stored, round(1000 * (time.perf_counter() - began)))
        write(spark.createDataFrame([row], BATCH_COUNTS), folders.counts)
    # A repeated batch needs the state before it, so only older state goes.
    for path in (folders.history, folders.last_alerts):
        if batch > 1:
            remove_folder(spark, _of(batch - 2, path))


def start(spark: SparkSession, source: str, folders: Folders, detector: Detector, idle_us: int = IDLE_US, late_us: int | None = None,
          **options: str) -> StreamingQuery:
    """Start the query over all that is available; ``options`` are those of the file source."""
    def step(lines: DataFrame, batch: int) -> None:
        process_batch(lines, batch, folders, detector, idle_us, late_us)

    return stream_lines(spark, source, **options).writeStream.foreachBatch(step).option(
        "checkpointLocation", folders.checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, folders: Folders) -> DataFrame:
    """Counters of every micro-batch so far: one small row each."""
    return spark.read.schema(BATCH_COUNTS).parquet(f"{folders.counts}/batch=*")


def run_latency(spark: SparkSession, folders: Folders) -> DataFrame:
    """n events and p50, p95, p99 of how long the micro-batch of an event took, in milliseconds, by nearest rank."""
    return nearest_rank_of_counts(read_counts(spark, folders).select(F.col("ms").cast("double").alias("ms"), "events"), "ms", "events")


def detect_stream(spark: SparkSession, source: str, base: str, detector: Detector, idle_us: int = IDLE_US, late_us: int | None = None,
                  **options: str) -> Folders:
    """Process everything that is available in ``source`` and return the folders of the run.

    Call it again when more files have arrived: checkpoint and state folders carry everything over.
    """
    folders = Folders(base)
    last = lambda: read_counts(spark, folders).agg(F.max("batch")).first()[0] if has_folder(spark, folders.counts) else -1
    before = last()
    start(spark, source, folders, detector, idle_us, late_us, **options).awaitTermination()
    if last() > before:
        folders.run_counts = run_totals(read_counts(spark, folders).where(F.col("batch") > before))
    return folders
