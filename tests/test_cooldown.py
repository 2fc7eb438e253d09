import random

import pytest

from dnsflow.operators import cooldown
from dnsflow.operators.cooldown import apply_cooldown, last_emitted

SCHEMA = "threat_class string, flow_id string, ts_us long, seq long"


def model(rows, c, last=None):
    last, out = dict(last or {}), []
    for cls, flow, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        if (cls, flow) not in last or ts - last[cls, flow] >= c:
            last[cls, flow] = ts
            out.append(seq)
    return sorted(out)


def rows_of(n, seed):
    rng, t, rows = random.Random(seed), 0, []
    for seq in range(n):
        t += rng.choice([0, 1, 1, 2, 3, 9, 50 if rng.random() < 0.05 else 1])
        rows.append((rng.choice(["DGA", "DNS_TUNNELLING"]), rng.choice(["hot", "hot", "hot", "a", "b"]), t, seq))
    rng.shuffle(rows)
    return rows


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_anchor_is_the_last_emitted(spark):
    rows = [("DGA", "x", s * 1_000_000, i) for i, s in enumerate([0, 5, 29, 30, 45, 61])]
    assert seqs(apply_cooldown(spark.createDataFrame(rows, SCHEMA))) == [0, 3, 5]


@pytest.mark.parametrize("chunk", [1, 3, 64])
@pytest.mark.parametrize("c", [7, 30])
def test_equals_the_sequential_rule(spark, monkeypatch, chunk, c):
    monkeypatch.setattr(cooldown, "CHUNK_COOLDOWNS", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")   # runs cross batches
    try:
        rows = rows_of(2000, c + chunk)
        assert seqs(apply_cooldown(spark.createDataFrame(rows, SCHEMA), c)) == model(rows, c)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_state_carries_over_runs(spark):
    rows = rows_of(800, 1)
    cut = sorted(r[2] for r in rows)[400]
    early, late = [r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut]
    first = apply_cooldown(spark.createDataFrame(early, SCHEMA), 20)
    second = apply_cooldown(spark.createDataFrame(late, SCHEMA), 20, previous=last_emitted(first))
    assert sorted(seqs(first) + seqs(second)) == model(rows, 20)


def test_switched_off(spark):
    rows = rows_of(50, 2)
    assert len(seqs(apply_cooldown(spark.createDataFrame(rows, SCHEMA), None))) == 50


def test_times_near_the_end_of_long_end(spark):
    last = 2**63 - 1
    rows = [("DGA", "flow", t, i) for i, t in enumerate((0, 50, last - 100, last - 1, last))]
    got = sorted(r["ts_us"] for r in apply_cooldown(spark.createDataFrame(rows, SCHEMA), 30).collect())
    assert got[:3] == [0, 50, last - 100] and len(got) <= 4
