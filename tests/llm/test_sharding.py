"""Shards against the best partition found by trying all cuts, and the laws of places."""

import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dnsflow.llm import queries, sharding


def table_of_ends(spark, sizes):
    upto, rows = 0, []
    for size in sizes:
        upto += size
        rows.append((upto,))
    return spark.createDataFrame(rows, "upto long").repartition(3)


def best_capacity(sizes, shards):
    @lru_cache(None)
    def best(start, left):
        if left == 1 or start == len(sizes):
            return sum(sizes[start:])
        return min(max(sum(sizes[start:stop]), best(stop, left - 1)) for stop in range(start, len(sizes) + 1))

    return best(0, shards)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 5), st.sampled_from([3, 4096]))
def test_capacity_is_the_smallest(spark, sizes, shards, tries):
    capacity, cuts = sharding.minimax_cuts(table_of_ends(spark, sizes), sum(sizes), max(sizes), shards, tries)
    assert capacity == best_capacity(tuple(sizes), shards)
    ends = [0, *cuts]
    assert len(cuts) == shards and cuts[-1] == sum(sizes) and max(b - a for a, b in zip(ends, ends[1:])) == capacity
    sums = {sum(sizes[:i + 1]) for i in range(len(sizes))}
    assert set(cuts) <= sums


def check_laws(rows, texts, shards):
    """Gapless slots, copies together, near equal bytes."""
    slots, shard_of, bytes_of, groups = defaultdict(list), {}, defaultdict(int), defaultdict(int)
    for (key, size, crc, shard, slot), text in zip(rows, texts):
        raw = (text or "").encode()
        assert size == len(raw) + 1 and crc == zlib.crc32(raw)
        assert shard_of.setdefault(raw, shard) == shard and 0 <= shard < shards
        slots[shard].append(slot)
        bytes_of[shard] += size
        groups[raw] += size
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return bytes_of, groups


def placed(spark, data, shards):
    docs = spark.createDataFrame([(i, k, t, 0, 0) for i, (k, t) in enumerate(data)], "n long, doc_id long, text string, slot int, at int")
    got = sharding.place(docs, shards, row="n").orderBy("row").select("key", "size", "text_crc32", "shard", "slot").collect()
    return [tuple(r) for r in got]


def test_query_keeps_copies_together_and_bytes_near_equal(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_shard_cuts(spark, sf_dir).collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    own = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows]
    bytes_of, groups = check_laws(own, [texts[r[0]] for r in own], 16)
    mean = sum(bytes_of.values()) / 16
    assert len(bytes_of) == 16 and max(bytes_of.values()) <= mean + max(groups.values())


def test_hot_group_gets_a_shard_of_its_own_and_the_others_are_even(spark):
    data = [(i, "hot text " * 10) for i in range(400)] + [(1000 + i, f"text {i} " * 5) for i in range(900)] + [
        (5000 + i, f"copy {i % 3} " * 12) for i in range(150)]
    rows = placed(spark, data, 8)
    bytes_of, groups = check_laws(rows, [t for _, t in data], 8)
    hot = rows[0][3]
    assert bytes_of[hot] == max(groups.values()) == groups[data[0][1].encode()]
    others = [b for s, b in bytes_of.items() if s != hot]
    assert len(others) == 7 and max(others) < 1.1 * min(others)


def test_nulls_ties_and_repeated_rows(spark):
    data = [(None, None), (None, ""), (1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None), (3, "äö")]
    rows = placed(spark, data, 3)
    check_laws(rows, [t for _, t in data], 3)
    assert len({r[3] for r in rows if r[1] == 1}) == 1 and rows == placed(spark, data, 3)


@pytest.mark.parametrize("data", [[], [(1, "only")], [(1, "same"), (2, "same"), (3, "same")], [(1, None)]])
def test_small_tables(spark, data):
    check_laws(placed(spark, data, 16), [t for _, t in data], 16)


def test_written_shards_hold_every_row_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i % 50, f"text {i % 40}", f"x{i}", 9) for i in range(120)], "doc_id long, text string, extra string, slot int")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("doc_id", "text", "extra").collect())) == sorted(map(tuple, docs.drop("slot").collect()))
    spans = back.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot"), F.count("*")).collect()
    assert all(low == 0 and high == distinct - 1 == n - 1 for _, low, high, distinct, n in spans)
