import hashlib
from collections import Counter

import pytest

from dnsflow.operators import datasets as ds
from dnsflow.operators.scale import hash_rank, lookup_join, running_totals


def test_hash_rank_is_the_md5_order(spark):
    rows = [(i, i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g int")
    for group in ([], ["g"]):
        got = {r["k"]: r["rank"] for r in hash_rank(df, "k", 7, group, digits=1).collect()}
        for part in ([0, 1] if group else [None]):
            keys = [k for k, g in rows if part is None or g == part]
            keys.sort(key=lambda k: hashlib.md5(f"{k}:7".encode()).hexdigest())
            assert [got[k] for k in keys] == list(range(1, len(keys) + 1))


@pytest.mark.parametrize("cap", [0, 1, 17, 600])
def test_first_ranks_only(spark, cap):
    df = spark.createDataFrame([(i, i % 2) for i in range(1000)], "k long, g int")
    whole = hash_rank(df, "k", 7, ["g"], digits=2).where(f"rank <= {cap}")
    few = hash_rank(df, "k", 7, ["g"], digits=2, at_most=cap)
    assert sorted(few.collect()) == sorted(whole.collect())


def test_running_totals(spark):
    rows = [(i * 37 % 1009, i % 3, i) for i in range(1009)]
    df = spark.createDataFrame(rows, "o int, g int, v long")
    got = {(r["g"], r["o"]): r["t"] for r in running_totals(df, ["o"], {"t": "v"}, ["g"]).collect()}
    for g in range(3):
        total = 0
        for o, _, v in sorted(r for r in rows if r[1] == g):
            total += v
            assert got[g, o] == total


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_join_equals_the_plain_one(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i % 7, i) for i in range(600)], "k int, seq long")
    right = spark.createDataFrame([(k, f"v{k}") for k in (0, 1, 3, 9)], "k int, v string")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()))
    salted = lookup_join(left, right, ["k"], how, spread=["seq"], broadcast_bytes=1, hot_rows=50, salts=8)
    assert sorted(map(tuple, salted.collect())) == plain


@pytest.fixture(scope="module")
def labelled(spark):
    dga = spark.createDataFrame(
        [(f"d{i}.com", "big" if i < 80 else "small") for i in range(100)], "domain string, family string")
    benign = spark.createDataFrame([(f" B{i % 150}.org ",) for i in range(300)], "domain string")
    return dga, ds.clean_domains(benign)


def test_cap_balance_split(labelled):
    dga, benign = labelled
    assert benign.count() == 150
    capped = ds.cap_per_group(dga, "family", "domain", 30)
    assert {r["family"]: r["count"] for r in capped.groupBy("family").count().collect()} == {"big": 30, "small": 20}
    table, short = ds.balance(dga, benign)
    assert short == 0 and table.groupBy("label").count().count() == 2 and table.count() == 200
    assert ds.balance(dga.unionByName(dga), benign)[1] == 50
    split = ds.stratified_split(table, "domain")
    counts = Counter((r["label"], r["is_test"]) for r in split.collect())
    assert counts == {(0, True): 20, (0, False): 80, (1, True): 20, (1, False): 80}
    assert [r["family"] for r in ds.families(table).collect()] == ["big", "small"]
    order = [r["domain"] for r in ds.shuffled(table, "domain").collect()]
    assert order == sorted(order, key=lambda d: hashlib.md5(f"{d}:42".encode()).hexdigest())


def test_leave_one_out(labelled):
    table = ds.labelled_domains(*labelled)
    for disjoint in (True, False):
        train, test = ds.leave_one_out(table, "small", disjoint_benign=disjoint)
        train_d = {r["domain"] for r in train.collect()}
        test_rows = test.collect()
        assert Counter(r["family"] for r in test_rows) == {"small": 20, "benign": 45}
        assert not any(r["family"] == "small" for r in train.collect())
        overlap = train_d & {r["domain"] for r in test_rows}
        assert len(overlap) == (0 if disjoint else 45)


def test_fixed_sessions(spark):
    rows = [(i, i % 5, f"q{i % 90}", 20 + i % 7, [1, 16, 10][i % 3] if i % 5 else 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, qname string, qd_qname_len int, qd_qtype int")
    out = ds.fixed_sessions(df.withColumn("tool", ds.tool_name(df["label"])), "id").collect()
    assert Counter(r["tool"] for r in out) == {"normal": 8, "dns2tcp": 2, "dnscapy": 2, "iodine": 2, "tuns": 2}
    for r in out:
        normal = r["tool"] == "normal"
        assert r["query_rate"] == (12 if normal else 40) and r["label"] == ("normal" if normal else "tunnel")
        assert 20 <= r["avg_query_len"] <= 26 and r["nxdomain_rate"] == 0.0
        assert (r["non_a_ratio"] == 0.0 and r["record_type_entropy"] == 0.0) if normal else r["record_type_entropy"] > 1


def test_bootstrap_sessions(spark):
    pool = spark.createDataFrame(
        [(i, f"site{i}.example.com", 10 + i % 30, 1) for i in range(500)],
        "id long, qname string, qd_qname_len int, qd_qtype int")
    out = ds.bootstrap_sessions(pool, "id").collect()
    assert len(out) == 416
    assert sum(r["unique_subdomains"] / r["query_rate"] for r in out) / 416 < 0.5
    for r in out:
        assert r["unique_subdomains"] <= 5 and 8 <= r["query_rate"] <= 20
        assert 10 <= r["avg_query_len"] <= 39 and (r["label"], r["tool"]) == ("normal", "normal_realistic")
    assert sorted(out) == sorted(ds.bootstrap_sessions(pool, "id").collect())


def test_lookup_salts_every_hot_key(spark):
    left = spark.range(7500).selectExpr("id as seq", "id % 2500 as k")
    right = spark.range(0, 2600, 2).selectExpr("id as k", "id * 10 as v")
    salted = lookup_join(left, right, ["k"], "left", spread=["seq"], broadcast_bytes=0, hot_rows=2, salts=3)
    assert sorted(map(tuple, salted.select("seq", "k", "v").collect()), key=str) == sorted(
        map(tuple, left.join(right, ["k"], "left").select("seq", "k", "v").collect()), key=str)
