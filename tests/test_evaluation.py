import json
import math
import random

import pytest

from dnsflow.operators import evaluation as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(800):
        y = int(rng.random() < 0.4)
        p = round(min(max(rng.gauss(0.35 + 0.35 * y, 0.2), 0.0), 1.0), 2)
        rows.append((y, p, int(p >= 0.5)))
    return rows, spark.createDataFrame(rows, "label int, p double, predicted int")


def test_confusion_and_report(scored):
    rows, df = scored
    c = ev.confusion_matrix(df).first()
    assert c["tp"] == sum(y and q for y, _, q in rows) and c["tn"] == sum(not y and not q for y, _, q in rows)
    r = {x["class"]: x for x in ev.classification_report(df).collect()}
    assert r["1"]["precision"] == pytest.approx(c["tp"] / (c["tp"] + c["fp"]))
    assert r["1"]["recall"] == pytest.approx(c["tp"] / (c["tp"] + c["fn"]))
    assert r["accuracy"]["f1"] == pytest.approx((c["tp"] + c["tn"]) / 800)
    assert r["0"]["support"] + r["1"]["support"] == r["macro avg"]["support"] == 800


def test_report_without_predictions_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "label int, predicted int")
    r = {x["class"]: x for x in ev.classification_report(df).collect()}
    assert r["0"]["f1"] == r["1"]["precision"] == r["1"]["f1"] == 0.0


def test_auc_counts_pairs(scored):
    rows, df = scored
    pos, neg = [p for y, p, _ in rows if y], [p for y, p, _ in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert ev.roc_auc(df).first()["auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert math.isnan(ev.roc_auc(df.where("label = 1")).first()["auc"])


def test_curve_tiers_and_points(scored):
    rows, df = scored
    total = sum(y for y, _, _ in rows)
    curve = {r["threshold"]: r for r in ev.precision_recall_curve(df).collect()}
    assert (curve[None]["precision"], curve[None]["recall"]) == (1.0, 0.0)
    for t in sorted({p for _, p, _ in rows}):
        flagged = [y for y, p, _ in rows if p >= t]
        assert curve[t]["precision"] == pytest.approx(sum(flagged) / len(flagged))
        assert curve[t]["recall"] == pytest.approx(sum(flagged) / total)
    tiers = {r["cut"]: r for r in ev.severity_tiers(df).collect()}
    assert set(tiers) == {0.30, 0.60, 0.85}
    assert tiers[0.30]["precision"] <= tiers[0.60]["precision"] <= tiers[0.85]["precision"]
    for cut, r in tiers.items():
        assert r["n_flagged"] == sum(p >= cut for _, p, _ in rows)
    points = {r["max_false_discovery_rate"]: r for r in ev.operating_points(df).collect()}
    assert set(points) == set(ev.FALSE_DISCOVERY_TARGETS)
    for target, r in points.items():
        ok = [(c["recall"], -t) for t, c in curve.items() if t is not None and 1 - c["precision"] <= target]
        assert (r["threshold"] is None) if not ok else (r["recall"], -r["threshold"]) == max(ok)
    json.dumps([r.asDict() for r in points.values()])


def test_nothing_above_a_cut(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "label int, p double")
    r = ev.severity_tiers(df, [0.9]).first()
    assert (r["precision"], r["recall_at_or_above"], r["n_flagged"]) == (1.0, 0.0, 0)


def test_ranked_values(spark):
    rng = random.Random(2)
    values = [rng.choice([1.0, 2.0, 2.0, rng.random() * 10]) for _ in range(333)]
    df = spark.createDataFrame([(v, "x") for v in values], "v double, g string")
    s, n = sorted(values), len(values)
    row = ev.nearest_rank(df, "v").first()
    assert [row["p50"], row["p95"], row["p99"]] == [s[min(int(p * n), n - 1)] for p in (0.5, 0.95, 0.99)]
    assert ev.nearest_rank(df, "v", (0.5,), ["g"]).first()["p50"] == s[n // 2]
    assert ev.nearest_rank(df.where("v < 0"), "v").first()["p50"] == 0.0
    even = df.where(f"v > {s[0]}")
    s2 = [v for v in s if v > s[0]]
    assert ev.medians(even, ["v"]).first()["median"] == (s2[(len(s2) - 1) // 2] + s2[len(s2) // 2]) / 2
    at = 0.02 * (n - 1)
    low = s[int(at)]
    assert ev.quantile(df, "v", 0.02).first()["quantile"] == pytest.approx(low + (s[int(at) + 1] - low) * (at - int(at)))


def test_verdict(spark):
    row = spark.range(1).select(ev.verdict(1.0, 0.4).alias("a"), ev.verdict(1.0, 0.5).alias("b")).first()
    assert (row["a"], row["b"]) == ("supported", "not supported")


def test_nearest_rank_of_batches_equals_that_of_all_values(spark):
    import random

    from dnsflow.operators.evaluation import nearest_rank, nearest_rank_of_counts, value_counts
    from dnsflow.operators.scale import union_all

    rng = random.Random(9)
    rows = [(i % 5, round(rng.expovariate(1.0), 1)) for i in range(700)] + [(2, None)]
    df = spark.createDataFrame(rows, "batch int, ms double")
    left = union_all([value_counts(df.where(f"batch = {b}"), "ms") for b in range(5)])
    assert nearest_rank_of_counts(left, "ms").collect() == nearest_rank(df, "ms").collect()
    assert [tuple(r) for r in nearest_rank_of_counts(left.limit(0), "ms").collect()] == [
        tuple(r) for r in nearest_rank(df.limit(0), "ms").collect()]
