"""Streaming window features: per slide with a native aggregation, per event with keyed state."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dnsflow.operators.windows import BUCKET_US, N_BUCKETS, SKETCH_LG_K

FEATURE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.DoubleType()), T.StructField("ts_us", T.LongType()),
    T.StructField("src_ip", T.StringType()), T.StructField("query_rate", T.LongType()),
    *[T.StructField(f, T.DoubleType()) for f in (
        "unique_subdomains", "avg_query_len", "txt_ratio", "nxdomain_rate", "non_a_ratio", "record_type_entropy")],
])


def time_mode(ttl_ms: int | None) -> str:
    return "None" if ttl_ms is None else "ProcessingTime"


def with_event_time(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Event-time column with a watermark: later rows are dropped by stateful operators and counted."""
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def hopping_stream(
    events: DataFrame, bucket_us: int = BUCKET_US, n_buckets: int = N_BUCKETS, delay: str = "10 seconds",
    sketch: bool = False,
) -> DataFrame:
    """Features of each window when the watermark passes its end.

    Queries are first counted per window, source and record type, and per window, source and
    name; a second aggregation adds these up. Both combine before the shuffle and hold counters
    only, so a busy source is spread over its types and names. ``sketch`` replaces the count of
    names by a HyperLogLog estimate with bounded state.
    """
    window = F.window("event_time", f"{bucket_us * n_buckets} microseconds", f"{bucket_us} microseconds")
    timed = with_event_time(events, delay)
    count = F.count(F.lit(1))
    of_type = lambda q: F.when(F.col("qtype") == q, F.col("n")).otherwise(F.lit(0))
    sketched = F.hll_sketch_agg("domain", F.lit(SKETCH_LG_K)) if sketch else F.lit(None).cast("binary")
    by_type = timed.groupBy(window, "src_ip", "qtype").agg(
        count.alias("n"), F.sum("length").alias("len"), F.count(F.when(F.col("nxdomain"), 1)).alias("nx"),
        sketched.alias("sketch"),
    ).select(
        "window", "src_ip", "n", "len", "nx", of_type("TXT").alias("txt"), of_type("A").alias("a"),
        (F.col("n") * F.log2(F.col("n").cast("double"))).alias("terms"), F.lit(0).cast("long").alias("names"), "sketch")
    parts = by_type
    if not sketch:
        none = F.lit(0).cast("long")
        by_name = timed.groupBy(window, "src_ip", "domain").agg(count.alias("times")).select(
            "window", "src_ip", none.alias("n"), F.lit(0.0).alias("len"), none.alias("nx"), none.alias("txt"),
            none.alias("a"), F.lit(0.0).alias("terms"), F.lit(1).cast("long").alias("names"),
            F.lit(None).cast("binary").alias("sketch"))
        parts = by_type.unionByName(by_name)
    names = F.hll_sketch_estimate(F.hll_union_agg("sketch")) if sketch else F.sum("names")
    n = F.col("n")
    summed = parts.groupBy("window", "src_ip").agg(
        *[F.sum(c).alias(c) for c in ("n", "len", "nx", "txt", "a", "terms")], names.cast("double").alias("names"))
    end = F.unix_micros(F.col("window.end"))
    return summed.select(
        "src_ip", (F.floor(end / bucket_us) - 1).cast("long").alias("slide"), n.alias("query_rate"),
        F.col("names").alias("unique_subdomains"), (F.col("len") / n).alias("avg_query_len"),
        (F.col("txt") / n).alias("txt_ratio"), (F.col("nx") / n).alias("nxdomain_rate"),
        ((n - F.col("a")) / n).alias("non_a_ratio"),
        F.greatest(F.lit(0.0), F.log2(n.cast("double")) - F.col("terms") / n).alias("record_type_entropy"),
        F.col("window.end").alias("window_end"))


class _WindowState(StatefulProcessor):
    """Per source: one map entry per live bucket with its counters and names.

    Stored buckets and new rows are put in one order, by bucket, stored ones first; all features are running sums over it.
    """

    def __init__(self, bucket_us: int, n_buckets: int, ttl_ms: int | None):
        self._bucket_us, self._n_buckets, self._ttl_ms = bucket_us, n_buckets, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "n long, len double, nx long, types array<string>, counts array<long>, names array<string>"
        self._buckets = handle.getMapState("buckets", "bucket long", value, self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        stored = {b: v for (b,), v in self._buckets.iterator()}
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "seq"], ignore_index=True)
        new["bucket"] = new["ts_us"] // self._bucket_us
        yield _features_after_each(new, stored, self._n_buckets, key[0])
        oldest = max(int(new["bucket"].max()), max(stored, default=0)) - self._n_buckets + 1
        for bucket in [b for b in stored if b < oldest]:
            self._buckets.removeKey((bucket,))
        for bucket, part in new[new["bucket"] >= oldest].groupby("bucket"):
            n, length, nx, types, counts, names = stored.get(bucket, (0, 0.0, 0, [], [], []))
            types = Counter(dict(zip(types, counts))) + Counter(part["qtype"])
            self._buckets.updateValue((int(bucket),), (
                n + len(part), length + float(part["length"].sum()), nx + int(part["nxdomain"].sum()), list(types),
                list(types.values()), sorted({*names, *part["domain"]})))

    def close(self) -> None:
        pass


def _features_after_each(new: pd.DataFrame, stored: dict[int, tuple], n_buckets: int, source: str) -> pd.DataFrame:
    """The seven features after each new row; a row older than the source's whole window gives none."""
    old = sorted(stored)
    buckets = np.concatenate([np.array(old, np.int64), new["bucket"].to_numpy(np.int64)])
    order = np.lexsort((np.arange(len(buckets)), buckets))      # stored buckets come first among equals
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = buckets[order]
    newest = np.maximum.accumulate(np.concatenate([[max(old, default=np.iinfo(np.int64).min)], new["bucket"].to_numpy(np.int64)]))[1:]
    first = at.searchsorted(at - n_buckets, "right")            # where the window of a row begins

    def in_window(past: list, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.concatenate([np.array(past, values.dtype), values])[order])])
        return (total[1:] - total[first])[place[len(old):]]

    n = in_window([stored[b][0] for b in old], np.ones(len(new), np.int64))
    share = lambda x: x / np.maximum(n, 1)
    by_type = {t: in_window([dict(zip(stored[b][3], stored[b][4])).get(t, 0) for b in old], (new["qtype"] == t).to_numpy(np.int64))
               for t in {*new["qtype"], *(t for b in old for t in stored[b][3])}}
    parts = np.array([share(c) for c in by_type.values()])
    entropy = -np.where(parts > 0, parts * np.log2(np.where(parts > 0, parts, 1.0)), 0.0).sum(axis=0)
    # A name counts from each occurrence to its next one or to the end of that occurrence's windows.
    seen = pd.DataFrame({
        "name": [x for b in old for x in stored[b][5]] + new["domain"].tolist(),
        "place": [int(place[i]) for i, b in enumerate(old) for _ in stored[b][5]] + place[len(old):].tolist()})
    seen = seen.sort_values(["name", "place"], ignore_index=True)
    begin = seen["place"].to_numpy()
    following = np.where(seen["name"].eq(seen["name"].shift(-1)), seen["place"].shift(-1, fill_value=0), len(at))
    end = np.minimum(following, at.searchsorted(at[begin] + n_buckets))
    change = np.zeros(len(at) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    names = np.cumsum(change)[place[len(old):]]
    out = pd.DataFrame({
        "seq": new["seq"], "ts": new["ts"], "ts_us": new["ts_us"], "src_ip": source, "query_rate": n,
        "unique_subdomains": names.astype(float),
        "avg_query_len": share(in_window([stored[b][1] for b in old], new["length"].to_numpy(float))),
        "txt_ratio": share(by_type.get("TXT", np.zeros(len(new)))),
        "nxdomain_rate": share(in_window([stored[b][2] for b in old], new["nxdomain"].to_numpy(np.int64))),
        "non_a_ratio": share(n - by_type.get("A", 0)), "record_type_entropy": np.maximum(entropy, 0.0)})
    return out[new["bucket"].to_numpy() > newest - n_buckets][FEATURE_SCHEMA.fieldNames()]


def window_features_stream(
    events: DataFrame, bucket_us: int = BUCKET_US, n_buckets: int = N_BUCKETS, ttl_ms: int | None = None,
) -> DataFrame:
    """The seven features after each event of a stream, with the window kept as state per source.

    Needs the RocksDB state store. Rows are put in ``(ts_us, seq)`` order within a micro-batch. A bucket that has not changed for
    ``ttl_ms`` of processing time is dropped; a stream that is to end by itself (``availableNow``) needs ``None``, as Spark keeps
    a stream with timed state alive. One task holds the rows of a source in a micro-batch: for sources too busy for that,
    ``streaming.detect`` runs the batch operator.
    """
    columns = ["seq", "ts", "ts_us", "src_ip", "domain", "qtype", "length", "nxdomain"]
    return events.select(*columns).groupBy("src_ip").transformWithStateInPandas(
        _WindowState(bucket_us, n_buckets, ttl_ms), FEATURE_SCHEMA, "Append", time_mode(ttl_ms))
