import json
import random

import pytest

from dnsflow.operators.cooldown import apply_cooldown
from dnsflow.operators.matching import match_responses_within
from dnsflow.operators.windows import hopping_features, window_features
from dnsflow.schemas import EVENT, MESSAGE
from dnsflow.streaming.cooldown import cooldown_stream
from dnsflow.streaming.detect import use_rocksdb
from dnsflow.streaming.matching import match_responses_stream
from dnsflow.streaming.windows import hopping_stream, window_features_stream
from tests.helpers import event
from tests.test_ingest import MESSAGES, message

FEATURES = ("query_rate", "unique_subdomains", "avg_query_len", "txt_ratio", "nxdomain_rate", "non_a_ratio",
            "record_type_entropy")


def rows_of(n=400, seed=4):
    rng, t, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        t += rng.choice([0, 0.25, 1.0, 2.5, 20.0])
        rows.append(event(seq, t, f"10.0.0.{rng.randint(1, 4)}", f"n{rng.randint(0, 15)}.example.com",
                          rng.choice(["A", "TXT", "NULL", "LOC", "HINFO"]), rng.randint(5, 60), rng.random() < 0.3))
    return rows


def write_parts(spark, rows, schema, path, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, tmp_path, name):
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}_out"))
             .option("checkpointLocation", str(tmp_path / f"{name}_cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    return query, stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / f"{name}_out"))


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_per_event_features_equal_batch(spark, tmp_path):
    use_rocksdb(spark)
    rows, path = rows_of(), str(tmp_path / "in")
    write_parts(spark, rows, EVENT, path, 3)
    _, out = run(window_features_stream(source(spark, EVENT, path)), tmp_path, "w5")
    got = {r["seq"]: r for r in out.collect()}
    want = window_features(spark.createDataFrame(rows, EVENT)).collect()
    assert len(got) == len(want)
    for r in want:
        for f in FEATURES:
            assert got[r["seq"]][f] == pytest.approx(r[f], abs=1e-7)


@pytest.mark.parametrize("sketch", [False, True])
def test_slides_equal_batch(spark, tmp_path, sketch):
    rows, path = rows_of(), str(tmp_path / "in")
    closing = event(len(rows), rows[-1][1] + 500, "10.9.9.9")
    write_parts(spark, [*rows, closing], EVENT, path, 3)
    query, out = run(hopping_stream(source(spark, EVENT, path), sketch=sketch), tmp_path, f"w4{sketch}")
    got = {(r["src_ip"], r["slide"]): r for r in out.collect()}
    want = hopping_features(spark.createDataFrame(rows, EVENT)).collect()
    assert len(got) == len(want)
    for r in want:
        for f in FEATURES:
            assert got[r["src_ip"], r["slide"]][f] == pytest.approx(r[f], abs=1e-6)
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([event(0, 1000.0)], [event(1, 1200.0)], [event(2, 900.0, "10.0.0.9")], [event(3, 2000.0)]):
        write_parts(spark, rows, EVENT, path, 1)
    query, out = run(hopping_stream(source(spark, EVENT, path)), tmp_path, "late")
    assert out.where("src_ip = '10.0.0.9'").count() == 0
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped > 0


def test_cooldown_equals_batch(spark, tmp_path):
    use_rocksdb(spark)
    schema = "threat_class string, flow_id string, ts_us long, seq long"
    rng, t, rows = random.Random(9), 0, []
    for seq in range(600):
        t += rng.choice([0, 1, 2, 40])
        rows.append((rng.choice(["DGA", "DNS_TUNNELLING"]), rng.choice("aab"), t, seq))
    path = str(tmp_path / "in")
    write_parts(spark, rows, schema, path, 4)
    _, out = run(cooldown_stream(source(spark, schema, path), 30), tmp_path, "w9")
    want = apply_cooldown(spark.createDataFrame(rows, schema), 30)
    assert sorted(r["seq"] for r in out.collect()) == sorted(r["seq"] for r in want.collect())


def test_stream_match_equals_batch(spark, tmp_path):
    first = MESSAGES[:10]   # one query has two responses
    rows = [*first, message(50, 3000.0, "z", "z", 1, 1, 0, 0, None, "close.me"), message(51, 3000.0, "z", "z", 1, 1, 0, 1, 0, "x")]
    rows += [message(52, 4000.0, "z", "z", 1, 1, 0, 0, None, "close.me"), message(53, 4000.0, "z", "z", 1, 1, 0, 1, 0, "x")]
    path = str(tmp_path / "in")
    for part in (rows[:-4], rows[-4:-2], rows[-2:]):
        write_parts(spark, part, MESSAGE, path, 1)
    _, out = run(match_responses_stream(source(spark, MESSAGE, path)), tmp_path, "j2")
    got = {r["seq"]: r["nxdomain"] for r in out.where("seq < 50").collect()}
    want = {r["seq"]: r["nxdomain"] for r in match_responses_within(spark.createDataFrame(first, MESSAGE)).collect()}
    assert got == want


def test_idle_sources_expire_by_event_time(spark, tmp_path):
    from dnsflow.streaming.expiry import idle_stream

    use_rocksdb(spark)
    parts = [[("a", 1.0), ("b", 1.0), ("a", 5.0), ("c", 1.0)], [("b", 400.0)], [("b", 650.0)], [("a", 900.0), ("b", 900.0)], [("b", 1300.0)], [("b", 1310.0)]]
    rows = [event(i, ts, ip, "x.com", "A", 5) for i, (ip, ts) in enumerate(r for part in parts for r in part)]
    path = str(tmp_path / "in")
    for i, part in enumerate(parts):
        at = sum(map(len, parts[:i]))
        write_parts(spark, rows[at:at + len(part)], EVENT, path, 1)
    _, out = run(idle_stream(source(spark, EVENT, path)), tmp_path, "idle")
    got = sorted((r["src_ip"], r["last_seen_us"], r["events"]) for r in out.collect())
    # b pauses for less than the watermark needs to tell; a goes twice and starts anew in between.
    assert got == [("a", 5_000_000, 2), ("a", 900_000_000, 1), ("c", 1_000_000, 1)]
    assert all(r["watermark_us"] >= r["last_seen_us"] + 300_000_000 for r in out.collect())
