import random

import pytest

from dnsflow.operators.windows import features_at, hopping_features, idle_sources, unique_names, window_features
from dnsflow.schemas import EVENT
from tests.helpers import event, model_windows


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def random_rows(n=1500, seed=3):
    rng, t, rows = random.Random(seed), 0.0, []
    for seq in range(n):
        t += rng.choice([0, 0, 0.25, 1.0, 2.5, 30.0])
        ip = "10.0.0.1" if rng.random() < 0.6 else f"10.0.0.{rng.randint(2, 9)}"   # one hot source
        rows.append(event(seq, t, ip, f"n{rng.randint(0, 25)}.example.com", rng.choice(["A", "A", "TXT", "NULL"]),
                          rng.randint(5, 60), rng.random() < 0.3))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [1 << 20, 7])
def test_per_event_features_equal_the_sequential_model(spark, block_rows):
    rows = random_rows()
    expected = model_windows(rows)
    got = window_features(frame(spark, rows), block_rows=block_rows).collect()
    assert len(got) == len(rows)
    for row in got:
        for name, value in expected[row["seq"]].items():
            assert row[name] == pytest.approx(value, abs=1e-7), (row["seq"], name)


def test_slide_features_equal_the_last_event_of_a_bucket(spark):
    rows = random_rows(600, 5)
    expected = {}
    model = model_windows(rows)
    for r in sorted(rows):
        expected[(r[2], r[7] // 5_000_000)] = model[r[0]]
    got = {(r["src_ip"], r["slide"]): r for r in hopping_features(frame(spark, rows)).collect()}
    for key, features in expected.items():
        for name, value in features.items():
            assert got[key][name] == pytest.approx(value, abs=1e-7), (key, name)


def test_tasks_grow_with_the_events(spark):
    rows = random_rows(600, 9)
    one, many = (window_features(frame(spark, rows), task_rows=n) for n in (1 << 20, 50))
    assert many.rdd.getNumPartitions() == 1 + 4 * 600 // 50
    assert sorted(many.collect()) == sorted(one.collect())
    one, many = (hopping_features(frame(spark, rows), task_rows=n) for n in (1 << 20, 50))
    assert many.rdd.getNumPartitions() == 1 + 4 * 12 * 600 // 200
    assert sorted(many.collect()) == sorted(one.collect())


def burst(n=60):
    return [event(i, i, "10.0.0.7", f"{i}-part.leak.test.org", "TXT", 55, True) for i in range(n)]


def test_burst_then_decay(spark):
    e = frame(spark, burst())
    probes = spark.createDataFrame([("10.0.0.7", 59_000_000), ("10.0.0.7", 119_000_000)], "src_ip string, ts_us long")
    during, after = sorted(features_at(e, probes).collect(), key=lambda r: r["ts_us"])
    assert (during["query_rate"], during["unique_subdomains"], during["avg_query_len"]) == (60, 60.0, 55.0)
    assert (during["txt_ratio"], during["nxdomain_rate"]) == (1.0, 1.0)
    assert all(after[c] == 0 for c in after.asDict() if c not in ("src_ip", "ts_us"))


def test_bucket_edges_and_repeats(spark):
    rows = [event(i, i, domain=f"again{i % 3}.test.org") for i in range(10)]
    rows += [event(10, 4.999, "b", "x"), event(11, 5.0, "b", "x"), event(12, 59.999, "b", "y"), event(13, 60.0, "b", "y")]
    got = {r["seq"]: r for r in window_features(frame(spark, rows)).collect()}
    assert got[9]["unique_subdomains"] == 3
    assert [got[i]["query_rate"] for i in (10, 11, 12, 13)] == [1, 2, 3, 3]


def test_quiet_source_does_not_accumulate(spark):
    rows = [event(i, 30.0 * i, domain=f"quiet{i}.test.org") for i in range(120)]
    for row in window_features(frame(spark, rows)).collect():
        assert row["query_rate"] <= 3 and row["unique_subdomains"] <= 3


def test_flood_is_estimated(spark):
    rows = [event(i, 0.0, domain=f"{i}-storm.test.org", qtype="TXT") for i in range(500)]
    rows += [event(500, 0.0, "10.0.0.2", "single.test.org")]
    got = {r["src_ip"]: r for r in unique_names(frame(spark, rows)).where("slide = 0").collect()}
    assert got["10.0.0.1"]["is_estimate"] and abs(got["10.0.0.1"]["unique_subdomains"] - 500) < 25
    assert not got["10.0.0.2"]["is_estimate"] and got["10.0.0.2"]["unique_subdomains"] == 1


def test_idle_sources(spark):
    rows = [event(0, 0.0, "a"), event(1, 301.0, "b"), event(2, 600.0, "c")]
    idle = {r["src_ip"]: r["idle"] for r in idle_sources(frame(spark, rows)).collect()}
    assert idle == {"a": True, "b": False, "c": False}


def test_empty_input(spark):
    assert window_features(frame(spark, [])).count() == 0
