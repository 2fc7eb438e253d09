"""Windows from carried aggregates, late events, and line numbers over input splits."""

import json
import random

from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize, scratch
from dnsflow.operators.windows import Carried, window_features
from dnsflow.schemas import EVENT
from dnsflow.sources.events import accepted, check_events, read_numbered_lines, rejected, with_arrival_number
from dnsflow.streaming.detect import NAMES, SOURCES, TYPES, mark_late
from tests.helpers import event

BUCKET_US = 5_000_000


def nothing(spark):
    return Carried(spark.createDataFrame([], TYPES), spark.createDataFrame([], NAMES))


def random_events(n, seed, ordered=True):
    rng = random.Random(seed)
    times = [round(rng.uniform(0, 200), 1) for _ in range(n)]
    rows = [event(0, ts, f"10.0.0.{rng.randrange(4)}", f"n{rng.randrange(12)}.com", rng.choice(["A", "TXT", "MX"]), rng.randrange(5, 40),
                  rng.random() < 0.2) for ts in (sorted(times) if ordered else times)]
    return [(i, *r[1:]) for i, r in enumerate(rows)]


def values(features):
    return {r["seq"]: tuple(round(float(x), 9) for x in r[4:]) for r in features.collect()}


def test_carried_windows_equal_those_over_all_events(spark):
    for ordered in (True, False):
        rows = random_events(400, 5, ordered)
        # Without order, "arrived so far" is what earlier parts hold, so a part is compared with all events up to its end.
        past, got, want = nothing(spark), {}, {}
        for low, high in ((0, 150), (150, 290), (290, 400)):
            part = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows[low:high])], EVENT)
            got |= {low + seq: v for seq, v in values(window_features(part, BUCKET_US, block_rows=16, past=past)).items()}
            upto = window_features(spark.createDataFrame(rows[:high], EVENT), BUCKET_US).where(F.col("seq") >= low)
            want |= values(upto)
            added = past.plus(part, BUCKET_US)
            past = Carried(materialize(added.types), materialize(added.names))
        assert got == want


def test_state_does_not_grow_with_the_events_of_a_window(spark):
    with scratch(spark):
        past, stored = nothing(spark), []
        for batch in range(50):
            rows = [event(i, 2.0 * batch + 0.01 * i, "10.0.0.1", f"n{i % 5}.com", "A", 9) for i in range(40 * (1 + batch % 3))]
            sources = spark.createDataFrame([("10.0.0.1", (2_000_000 * batch) // BUCKET_US - 12)], "src_ip string, oldest long")
            kept = past.plus(spark.createDataFrame(rows, EVENT), BUCKET_US).since(sources)
            past = Carried(materialize(kept.types), materialize(kept.names))
            stored.append(past.types.count() + past.names.count())
    assert max(stored) <= 14 * (1 + 5) and stored[-1] == stored[34]


def test_sources_that_are_gone_leave_nothing(spark):
    past = nothing(spark).plus(spark.createDataFrame([event(0, 1.0, "a", "x.com", "A", 5), event(1, 1.0, "b", "x.com", "A", 5)], EVENT))
    kept = past.since(spark.createDataFrame([("a", 0)], "src_ip string, oldest long"))
    assert [r["src_ip"] for r in kept.types.collect()] == ["a"] == [r["src_ip"] for r in kept.names.collect()]


def test_late_is_told_per_source(spark):
    events = spark.createDataFrame([event(i, float(ts), ip, "x.com", "A", 5) for i, (ip, ts) in enumerate(
        [("a", 10), ("a", 39), ("a", 40), ("b", 10), ("c", 0)])], EVENT)
    newest = spark.createDataFrame([("a", 100_000_000, 0), ("c", 60_000_000, 0)], SOURCES)
    got = {(r["src_ip"], r["ts"]): r["late"] for r in mark_late(events, newest, 60_000_000).collect()}
    assert got == {("a", 10.0): True, ("a", 39.0): True, ("a", 40.0): False, ("b", 10.0): False, ("c", 0.0): False}


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    good = {"src_ip": "10.0.0.1", "domain": "x.com", "qtype": "A", "length": 5}
    rng, wanted = random.Random(3), {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = []
        for i in range(1, 1500):
            kind = rng.randrange(5)
            lines.append("" if kind == 0 else f"{{broken {i}" if kind == 1 else json.dumps({**good, "ts": i // 7, "seq": i}))
            if kind == 1:
                wanted[name, i] = lines[-1]
        (tmp_path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "2500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = read_numbered_lines(spark, str(tmp_path))
            checked = check_events(lines)
            assert {(r["file_name"], r["line"]): r["raw"] for r in rejected(checked).collect()} == wanted
            # Equal times follow file and line, here the number that the line itself carries.
            own = with_arrival_number(accepted(checked).withColumn("own", F.col("seq"))).orderBy("ts_us", "seq").collect()
            assert [r["own"] for r in own if r["ts"] == 30.0][:1] and all(
                a["own"] < b["own"] or a["ts"] < b["ts"] or b["own"] // 7 == a["own"] // 7 for a, b in zip(own, own[1:]))
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (1 if size != before else 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ties_follow_file_and_line(spark):
    rows = [("b", 1, 0), ("a", 2, 1), ("a", 1, 2), ("b", 2, 3)]
    events = spark.createDataFrame([(file, line, 5, name) for file, line, name in rows], "file string, line long, ts_us long, name int").withColumn(
        "seq", F.lit(0))
    assert [r["name"] for r in with_arrival_number(events).orderBy("seq").collect()] == [2, 1, 0, 3]


def test_latency_of_a_run_weighs_batches_by_their_events(spark, tmp_path):
    from dnsflow.streaming.detect import BATCH_COUNTS, Folders, run_latency

    folders = Folders(str(tmp_path))
    for batch, (events, ms) in enumerate([(90, 10), (8, 200), (2, 3000)]):
        row = (batch, events, 0, events, 0, 0, 0, 0, 0, 0, 0, ms)
        spark.createDataFrame([row], BATCH_COUNTS).write.parquet(f"{folders.counts}/batch={batch}")
    assert tuple(run_latency(spark, folders).first()) == (100, 10.0, 200.0, 3000.0)
