"""Sliding-window features per source address.

A window is the current time bucket plus the ``n_buckets - 1`` before it. All operators first
reduce the events to per-bucket tables with map-side combining; only counters, never sets of
names, travel further. Numbers of distinct names and the record-type entropy are kept as
running sums of changes:

* a name counts in a window exactly once, at its earliest occurrence there, so an occurrence
  in bucket b whose previous one was in bucket p is counted for current buckets
  ``max(b, p + n_buckets) .. b + n_buckets - 1``;
* entropy is ``log2 N - (sum of c*log2 c over record types) / N``; each arrival changes only
  the term of its own type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dnsflow.operators.scale import TASK_ROWS, at_once, dealt, lookup_join, materialize, union_all

BUCKET_US = 5_000_000
N_BUCKETS = 12
PROMOTE_THRESHOLD = 40
SKETCH_LG_K = 12
BLOCK_ROWS = 1 << 20       # arrivals per block: bounds the rows one window group can hold

_COUNTERS = ("n", "len", "nx", "txt", "a")
_NANO = 1_000_000_000


def with_bucket(events: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Global tumbling bucket index."""
    return events.withColumn("bucket", F.expr(f"ts_us div {bucket_us}L"))


def _c_log2_c(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def _whole_and_rest(value: Column, name: str, sign: Column | int = 1) -> list[Column]:
    """A non-negative double as two integers, so that running sums over any history stay exact."""
    whole = F.floor(value)
    rest = F.round((value - whole) * _NANO).cast("long")
    return [(whole * sign).alias(name), (rest * sign).alias(f"{name}_rest")]


def _is(qtype: str, value: Column) -> Column:
    return F.when(F.col("qtype") == qtype, value).otherwise(F.lit(0))


def bucket_counters(events: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Per source, bucket and record type: queries, summed length, NXDOMAIN answers."""
    return events.groupBy("src_ip", "bucket", *extra_keys, "qtype").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("len"),
        F.sum(F.col("nxdomain").cast("long")).alias("nx"),
    )


def name_buckets(events: DataFrame, rows: int = 0, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per source, name and bucket: first arrival, and the bucket of the previous occurrence. ``rows``: how many events there are, if known."""
    by_name = Window.partitionBy("src_ip", "domain").orderBy("bucket")
    first = events.groupBy("src_ip", "domain", "bucket").agg(F.min("seq").alias("seq"))
    return dealt(first, rows, "src_ip", "domain", task_rows=task_rows).withColumn("previous", F.lag("bucket").over(by_name))


@dataclass
class Carried:
    """What earlier events leave to later windows: counters per source, bucket and record type, and the names per source and bucket.

    ``types``: src_ip, bucket, qtype, n, len, nx. ``names``: src_ip, domain, bucket. Both are as large as the different values that occur, however
    many events there were.
    """

    types: DataFrame
    names: DataFrame

    def plus(self, events: DataFrame, bucket_us: int = BUCKET_US) -> Carried:
        """With further events added."""
        e = with_bucket(events, bucket_us)
        types = self.types.unionByName(bucket_counters(e)).groupBy("src_ip", "bucket", "qtype").agg(
            *[F.sum(c).alias(c) for c in ("n", "len", "nx")])
        return Carried(types, self.names.unionByName(e.select("src_ip", "domain", "bucket")).distinct())

    def since(self, sources: DataFrame) -> Carried:
        """Buckets from ``oldest`` on of the sources in ``sources`` (src_ip, oldest); other sources go."""
        kept = lambda df: lookup_join(df, sources, ["src_ip"], "inner", spread=["bucket"]).where(
            F.col("bucket") >= F.col("oldest")).select(*df.columns)
        return Carried(kept(self.types), kept(self.names))


def _entropy(n: Column, terms: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log2(n.cast("double")) - terms.cast("double") / n)


def _features(n: Column, length: Column, nx: Column, txt: Column, a: Column, names: Column, terms: Column) -> list:
    return [
        n.cast("long").alias("query_rate"),
        names.cast("double").alias("unique_subdomains"),
        (length / n).cast("double").alias("avg_query_len"),
        (txt / n).cast("double").alias("txt_ratio"),
        (nx / n).cast("double").alias("nxdomain_rate"),
        ((n - a) / n).cast("double").alias("non_a_ratio"),
        _entropy(n, terms).alias("record_type_entropy"),
    ]


def window_features(
    events: DataFrame,
    bucket_us: int = BUCKET_US,
    n_buckets: int = N_BUCKETS,
    block_rows: int = BLOCK_ROWS,
    past: Carried | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The seven features after each event, counting only arrivals up to it (``seq`` order) and those in ``past``, which came before all.

    ``seq`` is the unique, dense arrival number. A bucket is cut into blocks of ``block_rows``
    consecutive arrivals; every block starts from carried totals, so a source or a single
    bucket that holds most of the table is still spread over many tasks. The event rows are
    shuffled once; the two bucket tables, each used several times, are written once. Beyond ``task_rows``
    events per shuffle partition the tasks grow in number, not in size.
    """
    span, n_events = n_buckets - 1, events.count()
    cell = ["src_ip", "bucket", "block"]
    e = with_bucket(events, bucket_us).withColumn("block", F.expr(f"seq div {block_rows}L"))

    # Count of each record type in the window when a block starts.
    in_window = Window.partitionBy("src_ip", "qtype").orderBy("bucket").rangeBetween(-span, -1)
    in_bucket = Window.partitionBy("src_ip", "qtype", "bucket").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    counted, seen = bucket_counters(e, ("block",)), e.select("src_ip", "domain", "bucket", "seq")
    if past is not None:    # the block before all others, of the sources that have new events
        now = materialize(e.select("src_ip").distinct())
        old = lambda df: lookup_join(df, now, ["src_ip"], "left_semi", spread=["bucket"])
        counted = counted.unionByName(old(past.types).withColumn("block", F.lit(-1).cast("long")))
        seen = seen.unionByName(old(past.names).withColumn("seq", F.lit(-1).cast("long")))
    types = dealt(counted, n_events, "src_ip", "qtype", task_rows=task_rows).withColumn(
        "held", F.coalesce(F.sum("n").over(in_window), F.lit(0)) + F.coalesce(F.sum("n").over(in_bucket), F.lit(0)))
    names = name_buckets(seen, n_events, task_rows).drop("domain")
    block = F.when(F.col("seq") < 0, F.lit(-1).cast("long")).otherwise(F.expr(f"seq div {block_rows}L"))
    types, names = at_once(lambda: materialize(types), lambda: materialize(names))

    cells = types.groupBy(*cell).agg(
        F.sum("n").alias("n"), F.sum("len").alias("len"), F.sum("nx").alias("nx"),
        F.sum(_is("TXT", F.col("n"))).alias("txt"), F.sum(_is("A", F.col("n"))).alias("a"),
        F.sum(_c_log2_c(F.col("held") + F.col("n")) - _c_log2_c(F.col("held"))).alias("terms"))

    # Earliest occurrences in the window, as arrivals of the current bucket.
    fresh = names.where(F.col("previous").isNull() | (F.col("previous") < F.col("bucket") - span)).select(
        "src_ip", "bucket", block.alias("block"), "seq")
    fresh_cells = fresh.groupBy(*cell).agg(F.count(F.lit(1)).alias("names"))

    # What enters the window of the following bucket and leaves it n_buckets later.
    sign = F.col("sign")
    type_moves = (
        types.groupBy("src_ip", "qtype", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("len").alias("len"), F.sum("nx").alias("nx"))
        .withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
        .withColumn("at", F.when(sign > 0, F.col("bucket") + 1).otherwise(F.col("bucket") + n_buckets))
    )
    so_far = Window.partitionBy("src_ip", "qtype").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.col("n") * sign
    type_moves = type_moves.withColumn("after", F.sum(moved).over(so_far))
    after, before = (_whole_and_rest(_c_log2_c(c), "terms") for c in (F.col("after"), F.col("after") - moved))
    type_moves = type_moves.select(
        "src_ip", "at", moved.alias("n"), *_whole_and_rest(F.col("len"), "len", sign), (F.col("nx") * sign).alias("nx"),
        _is("TXT", moved).alias("txt"), _is("A", moved).alias("a"),
        *[(x - y).alias(name) for x, y, name in zip(after, before, ("terms", "terms_rest"))])
    enters = F.greatest(F.col("bucket") + 1, F.coalesce(F.col("previous") + n_buckets, F.col("bucket") + 1))
    leaves = F.col("bucket") + n_buckets
    name_moves = (
        names.where(enters < leaves)
        .withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
        .select("src_ip", F.when(sign > 0, enters).otherwise(leaves).alias("at"), sign.cast("long").alias("names"))
    )
    moving = ("n", "len", "len_rest", "nx", "txt", "a", "terms", "terms_rest", "names")
    # Every event may enter and leave as a name and as a record type: four moves.
    moves = dealt(union_all([type_moves, name_moves]), 4 * n_events, "src_ip", "at", task_rows=task_rows)
    changes = moves.groupBy("src_ip", F.col("at").alias("bucket")).agg(*[F.sum(c).alias(f"d_{c}") for c in moving])

    # Totals carried into each block: the window before the bucket, then earlier blocks of the bucket.
    state = dealt(union_all([cells.withColumn("is_cell", F.lit(True)), fresh_cells, changes]), 4 * n_events, "src_ip", task_rows=task_rows)
    up_to_bucket = Window.partitionBy("src_ip").orderBy("bucket").rangeBetween(Window.unboundedPreceding, 0)
    earlier_blocks = Window.partitionBy("src_ip", "bucket").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    in_cell = (*_COUNTERS, "terms", "names")
    state = state.select(
        *cell, "is_cell", *[F.sum(f"d_{c}").over(up_to_bucket).alias(f"w_{c}") for c in moving],
        *[F.sum(c).over(earlier_blocks).alias(f"b_{c}") for c in in_cell],
    ).where(F.col("is_cell")).na.fill(0)
    rest = lambda c: F.col(f"w_{c}_rest") / _NANO if c in ("len", "terms") else F.lit(0)
    carry = state.select(
        *cell, F.lit(-1).cast("long").alias("seq"),
        *[(F.col(f"w_{c}") + rest(c) + F.col(f"b_{c}")).alias(c) for c in in_cell])
    type_carry = types.select(*cell, "qtype", F.col("held").alias("k"), F.lit(-1).cast("long").alias("seq"))

    rows = e.select(
        *cell, "seq", "ts_us", "qtype", F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("n"),
        F.col("length").alias("len"), F.col("nxdomain").cast("long").alias("nx"),
        _is("TXT", F.lit(1)).cast("long").alias("txt"), _is("A", F.lit(1)).cast("long").alias("a"),
        F.lit(True).alias("is_event"),
    )
    placed = union_all([
        rows, carry, type_carry, fresh.withColumn("names", F.lit(1).cast("long")),
    ]).where(F.col("block") >= 0)
    by_size = dealt(placed, 4 * n_events, *cell, task_rows=task_rows)
    placed = placed.repartition(*cell) if by_size is placed else by_size
    by_type = Window.partitionBy(*cell, "qtype").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(*cell).orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    held = F.col("held")
    totals = placed.withColumn("held", F.sum("k").over(by_type)).withColumn(
        "terms", F.when(F.col("is_event"), _c_log2_c(held) - _c_log2_c(held - 1)).otherwise(F.col("terms")))
    summed = totals.select(
        "seq", "ts_us", "src_ip", "bucket", "is_event",
        *[F.sum(c).over(upto).alias(f"s_{c}") for c in (*_COUNTERS, "names", "terms")],
    ).where(F.col("is_event"))
    c = {name: F.col(f"s_{name}") for name in (*_COUNTERS, "names", "terms")}
    return summed.select(
        "seq", "ts_us", "src_ip", "bucket",
        *_features(c["n"], c["len"], c["nx"], c["txt"], c["a"], c["names"], c["terms"]),
    )


def hopping_features(
    events: DataFrame, bucket_us: int = BUCKET_US, n_buckets: int = N_BUCKETS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """The seven features of every non-empty window, read when its last bucket (``slide``) closes.

    Counters per bucket and record type, and numbers of names that count from one slide to another, are put together by source before they are
    repeated per slide, in tasks whose number grows with the events.
    """
    span, n_events = n_buckets - 1, events.count()
    e = with_bucket(events, bucket_us)
    by_type = bucket_counters(e).withColumn("first", F.col("bucket"))
    first = F.greatest(F.col("bucket"), F.coalesce(F.col("previous") + n_buckets, F.col("bucket")))
    living = name_buckets(e, n_events, task_rows).where(first <= F.col("bucket") + span)
    names = (
        dealt(living, n_events, "src_ip", "bucket", task_rows=task_rows)
        .groupBy("src_ip", "bucket", first.alias("first")).agg(F.count(F.lit(1)).alias("names"))
    )
    both = union_all([by_type, names])
    by_size = dealt(both, 4 * n_buckets * n_events, "src_ip", task_rows=4 * task_rows)
    slides = F.explode(F.sequence(F.col("first"), F.col("bucket") + span)).alias("slide")
    s = {k: F.sum(k) for k in (*_COUNTERS, "names", "terms")}
    return (
        (both.repartition("src_ip") if by_size is both else by_size)
        .select("src_ip", slides, "qtype", "n", "len", "nx", "names")
        .groupBy("src_ip", "slide", "qtype")
        .agg(*[F.sum(c).alias(c) for c in ("n", "len", "nx", "names")])
        .withColumns({"txt": _is("TXT", F.col("n")), "a": _is("A", F.col("n")), "terms": _c_log2_c(F.col("n"))})
        .groupBy("src_ip", "slide").agg(*_features(s["n"], s["len"], s["nx"], s["txt"], s["a"], s["names"], s["terms"]))
    )


def features_at(
    events: DataFrame, probes: DataFrame, bucket_us: int = BUCKET_US, n_buckets: int = N_BUCKETS
) -> DataFrame:
    """Features of the window that ends at each probe ``(src_ip, ts_us)``; all zero when it is empty."""
    probes = with_bucket(probes, bucket_us)
    asked = materialize(probes.select("src_ip", F.col("bucket").alias("slide")).distinct())
    features = hopping_features(events, bucket_us, n_buckets).join(asked, ["src_ip", "slide"], "left_semi")
    joined = lookup_join(
        probes, materialize(features.withColumnRenamed("slide", "bucket")), ["src_ip", "bucket"], "left")
    return joined.na.fill(0).drop("bucket")


def unique_names(
    events: DataFrame,
    bucket_us: int = BUCKET_US,
    n_buckets: int = N_BUCKETS,
    promote_above: int = PROMOTE_THRESHOLD,
) -> DataFrame:
    """Distinct names per window: exact while every live bucket is small, else a HyperLogLog estimate."""
    span = n_buckets - 1
    names = name_buckets(with_bucket(events, bucket_us))
    slides = F.sequence(F.col("bucket"), F.col("bucket") + span)
    buckets = names.groupBy("src_ip", "bucket").agg(
        F.count(F.lit(1)).alias("in_bucket"), F.hll_sketch_agg("domain", F.lit(SKETCH_LG_K)).alias("sketch"))
    sketches = buckets.select("src_ip", F.explode(slides).alias("slide"), "in_bucket", "sketch").groupBy(
        "src_ip", "slide").agg(
        F.max("in_bucket").alias("largest_bucket"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("estimate"))
    exact = hopping_features(events, bucket_us, n_buckets).select("src_ip", "slide", "unique_subdomains")
    return sketches.join(exact, ["src_ip", "slide"]).select(
        "src_ip", "slide", (F.col("largest_bucket") > promote_above).alias("is_estimate"),
        F.when(F.col("largest_bucket") > promote_above, F.col("estimate"))
        .otherwise(F.col("unique_subdomains")).alias("unique_subdomains"))


def idle_sources(events: DataFrame, ttl_us: int = 300_000_000, now_us: int | None = None) -> DataFrame:
    """Last sighting of each source and whether it is idle for longer than the TTL at ``now_us``."""
    if now_us is None:
        now_us = events.agg(F.max("ts_us")).first()[0] or 0
    return events.groupBy("src_ip").agg(F.max("ts_us").alias("last_seen_us")).withColumn(
        "idle", F.col("last_seen_us") < F.lit(now_us - ttl_us))
