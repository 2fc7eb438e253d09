import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsflow.llm import hilbert as h

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, k):
    """Nearest rows of every tenth id by comparing with all."""
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in ids[ids % 10 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        own = [(float(s), int(i)) for s, i in zip(d, ids) if i != q]
        out[q] = [(i, pytest.approx(s, abs=1e-12)) for s, i in sorted(own)[:k]]
    return out


def found(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    out = {}
    for r in h.search(df, F.col("vec_id") % 10 == 0, k, **options).orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def vectors(n, size=8, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, draw.normal(size=size).astype(np.float32).tolist()) for i in range(n)]


def test_keys_walk_the_grid_in_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = h.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(side ** dims))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_whole_windows_give_the_exact_answer(spark):
    rows = vectors(150)
    assert found(spark, rows, 5, curves=2, window=1.0) == brute(rows, 5)


def test_recall_over_several_curves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 64)
    monkeypatch.setattr(h, "QUERIES", 256)
    rows = vectors(1200, 16)
    want, got = brute(rows, 10), found(spark, rows, curves=8, least_window=100)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want) and all(len(v) == 10 for v in got.values())


def test_equal_vectors_ties_and_few_rows(spark):
    same = [1.0] * 8
    rows = [(i, same) for i in range(40)] + [(40, [2.0] * 8), (50, [3.0] * 8)]
    got = found(spark, rows, 3, curves=2, window=1.0)
    assert got == brute(rows, 3)
    assert [i for i, _ in got[30]] == [0, 1, 2] and [i for i, _ in got[0]] == [1, 2, 3]
    assert [i for i, _ in found(spark, rows[:1] + rows[40:41])[0]] == [40]


def test_unusable_vectors_take_no_part(spark):
    good = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 0.5])]
    bad = [(20, None), (21, [0.0, 0.0]), (22, [1.0, None]), (23, [float("nan"), 1.0]), (24, [float("inf"), 1.0]), (25, [1.0]),
           (30, []), (None, [1.0, 1.0]), (12, [1.0, 0.5])]
    assert found(spark, good + bad) == {10: [(12, 0.5), (11, pytest.approx(2 ** 0.5))]}
    assert found(spark, []) == {} and found(spark, bad[:2]) == {}
