import json
import random

import pytest
from pyspark.sql import functions as F

from dnsflow.operators import ablation as ab
from dnsflow.operators import classifier as cl
from dnsflow.operators.alerts import severity
from dnsflow.operators.classifier import held_out_families, load_model, save_model, score_names, train_classifier
from dnsflow.operators.forest import Forest, average_path, train_forest
from dnsflow.operators.lexical import lexicon
from dnsflow.operators.scale import materialize
from dnsflow.operators.suffix import registrable_names
from dnsflow.plans.detect import Detector, detect, in_order, raw_alerts, scored_domains
from dnsflow.plans.train import evaluate_forest, featurized, train_and_evaluate
from dnsflow.queries import catalog
from dnsflow.schemas import EVENT, WINDOW_FEATURES
from dnsflow.sources.lists import EXTRA_SUFFIXES, FALLBACK_WORDS, read_words, suffix_rules
from dnsflow.sources.sinks import read_alerts, run_totals, write_alerts
from dnsflow.streaming.detect import COUNTS, Folders, detect_stream, process_batch, read_counts
from tests.helpers import SUFFIX_LINES, event

BURST_HOST = "203.0.113.7"


@pytest.fixture(scope="module")
def rules(spark):
    return materialize(suffix_rules(spark.createDataFrame([(x,) for x in SUFFIX_LINES], "value string"), EXTRA_SUFFIXES))


@pytest.fixture(scope="module")
def lex(spark):
    return lexicon(read_words(spark, None))


@pytest.fixture(scope="module")
def labelled(spark, rules, lex):
    rng, rows = random.Random(0), []
    for i in range(300):
        rows.append((f"{rng.choice(FALLBACK_WORDS)}{rng.choice(FALLBACK_WORDS)}{i % 7}.com", 0, "benign"))
        rows.append(("".join(rng.choice("bcdfghjkqxz0123456789") for _ in range(14)) + ".net", 1, f"f{i % 2}"))
    return featurized(spark.createDataFrame(sorted(set(rows)), "domain string, label int, family string"), rules, lex)


@pytest.fixture(scope="module")
def normal_windows(spark):
    rng = random.Random(1)
    rows = [(i, 5 + int(rng.expovariate(0.5)), 1.0 + int(rng.expovariate(1.0)), rng.gauss(17, 2), 0.0,
             max(0.0, rng.gauss(0.03, 0.02)), 0.0, 0.0) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, query_rate long, " + ", ".join(f"{f} double" for f in WINDOW_FEATURES[1:]))


@pytest.fixture(scope="module")
def forest(normal_windows):
    return train_forest(normal_windows, "id", n_trees=40)


@pytest.fixture(scope="module")
def detector(rules, lex, labelled, forest):
    return Detector(rules, lex, train_classifier(labelled, trees=8, depth=3), forest)


def traffic():
    rows = [event(i, 0.0, "10.0.0.5", d, "A", len(d)) for i, d in enumerate(
        ["google.com", "xqzplvmno-8f3ab21.net", "cloudshop.com"])]
    rows += [event(3 + i, float(i), BURST_HOST, f"{i}-exfil.example.com", "TXT", 60, True) for i in range(45)]
    rows += [event(100 + i, 0.5 * i, f"10.0.1.{i % 15}", "datamarket.com", "A", 14) for i in range(100)]
    rows += [event(300 + i, 20.0 * i, "10.0.2.1", "xk3j9qzb7w1x0.net", "A", 17) for i in range(5)]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def numbered(rows):
    return [(i, *r[1:]) for i, r in enumerate(rows)]


def key_rows(alerts):
    return sorted((r["timestamp"], r["flow_id"], r["threat_class"], r["severity"], round(r["confidence"], 9))
                  for r in alerts.collect())


def test_forest_is_deterministic_and_flags_its_share(spark, normal_windows, forest, tmp_path):
    again = train_forest(normal_windows.repartition(7), "id", n_trees=40)
    assert again.offset == forest.offset
    flagged = forest.score(normal_windows).where("decision < 0").count()
    assert 28 <= flagged <= 32      # 2 %
    assert forest.nodes.groupBy("tree").agg(F.max("depth").alias("d"), F.sum(F.when(F.expr("left = node"), F.col("size")).otherwise(0)).alias("n")).where("d > 8 or n <> 256").count() == 0
    forest.save(str(tmp_path / "forest"))
    loaded = Forest.load(spark, str(tmp_path / "forest"))
    odd = normal_windows.limit(1).withColumns({
        "query_rate": F.lit(90), "unique_subdomains": F.lit(90.0), "avg_query_len": F.lit(60.0), "nxdomain_rate": F.lit(1.0)})
    assert loaded.score(odd).first()["decision"] == forest.score(odd).first()["decision"] < 0


def test_classifier_roundtrip_and_batch_equals_single(labelled, detector, tmp_path):
    save_model(detector.classifier, str(tmp_path / "model"))
    batch = {r["domain"]: r["prob"] for r in score_names(detector.classifier, labelled).collect()}
    loaded = load_model(str(tmp_path / "model"))
    for domain in sorted(batch)[:5]:
        one = score_names(loaded, labelled.where(F.col("domain") == domain)).first()["prob"]
        assert one == pytest.approx(batch[domain], abs=1e-9)


def test_forest_scores_equal_a_walk_of_each_tree(normal_windows, forest):
    nodes = {(r["tree"], r["node"]): r for r in forest.nodes.collect()}
    odd = normal_windows.limit(700).withColumn("avg_query_len", F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("avg_query_len")))
    rows = forest.score(odd).collect()
    expected = float(average_path(forest.sample))
    for row in rows[:5] + rows[-5:] + [r for r in rows if r["avg_query_len"] != r["avg_query_len"]][:3]:
        paths = []
        for tree in range(40):
            at = nodes[tree, 0]
            while at["left"] != at["node"]:
                at = nodes[tree, at["left" if float(row[forest.features[at["feature"]]]) <= at["threshold"] else "right"]]
            paths.append(at["depth"] + float(average_path(at["size"])))
        assert row["decision"] == pytest.approx(-2 ** (-sum(paths) / 40 / expected) - forest.offset, abs=1e-9)


def test_fit_of_merged_rows_is_the_fit_of_all_rows(spark):
    rng, rows = random.Random(3), []
    for i in range(3000):
        label = int(rng.random() < 0.2)
        rows.append((label, float(rng.randrange(12) + 3 * label), float(rng.randrange(9)), 1.0))
    df = spark.createDataFrame(rows, "label int, a double, b double, same double")
    fit = {"features": ["a", "b", "same"], "trees": 6, "depth": 3}
    merged, whole = (train_classifier(df, whole_rows=n, **fit) for n in (0, 10_000))
    assert merged.stages[0].getInputCols() == fit["features"] and len(whole.stages) == 2
    probs = [{(r["a"], r["b"]): r["prob"] for r in score_names(m, df).collect()} for m in (merged, whole)]
    assert len(probs[0]) > 50 and probs[0] == pytest.approx(probs[1], abs=1e-9)


def test_bins_of_a_feature_with_many_values_are_quantiles_of_each_class(spark):
    df = spark.createDataFrame([(int(i % 10 == 0), float(i)) for i in range(5000)], "label int, x double")
    edges = cl.bin_edges(df, ["x"], "label", 21)[0]
    assert len(edges) <= 20 and edges == sorted(set(edges)) and max(b - a for a, b in zip([0, *edges], [*edges, 5000])) < 600
    model = train_classifier(df.withColumn("label", (F.col("x") > 2500).cast("int")), ["x"], trees=3, depth=2, whole_rows=0)
    assert score_names(model, df).where((F.col("prob") > 0.5) != (F.col("x") > 2500)).count() < 60


def test_training_run(labelled):
    run = train_and_evaluate(labelled, trees=5, depth=3)
    metrics = {r["metric"]: r["value"] for r in run.metrics.collect()}
    assert metrics["recall"] > 0.9 and metrics["auc"] > 0.9 and 0 <= metrics["brier"] <= 0.25
    assert run.calibration["operating_points"].count() == 7
    folds = {r["family"]: r["recall"] for r in held_out_families(labelled, trees=3, depth=2).collect()}
    assert set(folds) == {"f0", "f1"} and min(folds.values()) > 0.8


def test_every_family_is_held_out_and_a_restart_goes_on(spark, labelled, tmp_path, monkeypatch):
    fits, real = [], cl.train_classifier
    monkeypatch.setattr(cl, "train_classifier", lambda df, **fit: fits.append(fit) or real(df, trees=2, depth=2))
    base = str(tmp_path / "holdout")
    held_out_families(labelled, names=["f0"], folder=base)
    rows = {r["family"]: r for r in held_out_families(labelled, folder=base).collect()}
    assert len(fits) == 2 and set(rows) == {"f0", "f1"}
    assert all(0.8 < r["auc"] <= 1 and r["mean"] == pytest.approx((rows["f0"]["recall"] + rows["f1"]["recall"]) / 2) for r in rows.values())
    monkeypatch.setattr(catalog, "_featurized", lambda *_: labelled)
    assert {r["family"] for r in catalog.family_holdout(spark, "").collect()} == {"f0", "f1"} and fits == [{}] * 4


def test_detection(spark, detector, tmp_path):
    events = spark.createDataFrame(numbered(traffic()), EVENT)
    raw = raw_alerts(events, detector)
    alerts = detect(events, detector)
    rows = alerts.collect()
    assert {r["threat_class"] for r in rows} == {"DGA", "DNS_TUNNELLING"}
    times = {t for t, in events.select("ts").collect()}
    assert {r["timestamp"] for r in rows} <= times
    burst = sorted(r["timestamp"] for r in rows if r["flow_id"] == BURST_HOST)
    assert burst and burst[0] >= 4.0 and all(b - a >= 30 for a, b in zip(burst, burst[1:]))
    repeated = sorted(r["timestamp"] for r in rows if r["flow_id"] == "xk3j9qzb7w1x0.net")
    assert repeated == [0.0, 40.0, 80.0]
    assert len(rows) < raw.count()
    assert key_rows(detect(events, detector)) == key_rows(alerts)          # replay
    ordered = in_order(alerts)
    assert [r["timestamp"] for r in ordered.collect()] == sorted(r["timestamp"] for r in rows)
    write_alerts(ordered, str(tmp_path / "log"))
    for line in (x for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines()):
        alert = json.loads(line)
        expected = 9 if alert["threat_class"] == "DGA" else 7
        assert len(alert["evidence"]) == expected
    assert key_rows(read_alerts(spark, str(tmp_path / "log"))) == key_rows(alerts)


def test_allowlist_gates_names_only(spark, detector, rules):
    events = spark.createDataFrame(numbered(traffic()), EVENT)
    allow_all = registrable_names(events, rules).select("registrable_domain").distinct()
    gated = Detector(**{**detector.__dict__, "allowlist": allow_all})
    assert scored_domains(events, gated).count() == 0
    assert {r["threat_class"] for r in detect(events, gated).collect()} == {"DNS_TUNNELLING"}
    nothing = spark.createDataFrame([], EVENT)
    assert detect(nothing, detector).count() == 0


def test_stream_equals_batch(spark, detector, tmp_path):
    rows = numbered(traffic())
    names = ("seq", "ts", "src_ip", "domain", "qtype", "length", "nxdomain")
    lines = [json.dumps(dict(zip(names, r))) for r in rows]
    lines.insert(10, "{not valid json")
    lines.insert(40, '{"ts": 1.0}')
    source = tmp_path / "in"
    source.mkdir()
    half = len(lines) // 2
    (source / "a.jsonl").write_text("\n".join(lines[:half]))
    base = str(tmp_path / "run")
    detect_stream(spark, str(source), base, detector)
    (source / "b.jsonl").write_text("\n".join(lines[half:]))      # arrives later; state carries over
    folders = detect_stream(spark, str(source), base, detector)
    assert detect_stream(spark, str(source), base, detector).run_counts == {}      # nothing new
    bad = int(half <= 10) + int(half <= 40)
    counts = folders.run_counts
    assert (counts["lines"], counts["rejected"], counts["events"]) == (len(lines) - half, bad, len(lines) - half - bad)
    assert counts["active_sources"] > 0 and counts["expired_sources"] == 0
    everything = run_totals(read_counts(spark, folders))
    assert everything["lines"] == len(lines) and everything["alerts"] == read_alerts(spark, folders.alerts).count()
    left = {p.name for p in (tmp_path / "run" / "history").iterdir()}
    assert left == {"batch=0", "batch=1"}
    assert sorted(r["reason"] for r in spark.read.parquet(f"{folders.rejects}/batch=*").collect()) == [
        "invalid JSON", "missing required field(s): src_ip, domain, qtype, length"]
    batch = detect(spark.createDataFrame(rows, EVENT), detector)
    assert key_rows(read_alerts(spark, folders.alerts)) == key_rows(batch)


FIELDS = ("seq", "ts", "src_ip", "domain", "qtype", "length", "nxdomain")


def as_lines(rows):
    return [json.dumps(dict(zip(FIELDS, r))) for r in rows]


def feed(spark, folders, detector, batch, lines, **options):
    process_batch(spark.createDataFrame([(x,) for x in lines], "value string"), batch, folders, detector, **options)


def test_extreme_times_harm_no_other_source(spark, detector, tmp_path):
    rows, folders = numbered(traffic()), Folders(str(tmp_path / "run"))
    crafted = [json.dumps(dict(zip(FIELDS, (0, ts, "10.7.7.7", "xk3j9qzb7w1x0.net", "A", 17, False)))) for ts in (4e9, 1e15, 1e300)]
    crafted.append(crafted[0].replace("4000000000.0", "1e400"))
    half = len(rows) // 2
    feed(spark, folders, detector, 0, [*as_lines(rows[:half]), *crafted])
    feed(spark, folders, detector, 1, as_lines(rows[half:]))
    got = [k for k in key_rows(read_alerts(spark, folders.alerts)) if k[0] != 4e9]
    assert got == key_rows(detect(spark.createDataFrame(rows, EVENT), detector))
    reasons = [r["reason"] for r in spark.read.parquet(f"{folders.rejects}/batch=*").collect()]
    assert len(reasons) == 3 and all(r.startswith("ts is out of range") for r in reasons)


def test_idle_keys_expire_and_scratch_tables_go(spark, detector, tmp_path):
    folders = Folders(str(tmp_path / "run"))
    name = "xk3j9qzb7w1x0.net"
    early = [event(i, float(i), f"10.1.0.{i}", name, "A", 17) for i in range(4)]
    late = [event(i, 5000.0 + i, f"10.2.0.{i}", name, "A", 17) for i in range(9)]
    before = {p.name for p in (tmp_path.parent).rglob("scratch-*")}
    feed(spark, folders, detector, 0, as_lines(early))
    feed(spark, folders, detector, 1, as_lines(late))
    counts = {r["batch"]: r for r in read_counts(spark, folders).collect()}
    assert (counts[0]["active_sources"], counts[0]["expired_sources"]) == (4, 0)
    assert (counts[1]["active_sources"], counts[1]["expired_sources"]) == (9, 4)
    assert counts[1]["active_flows"] == 1
    assert {p.name for p in (tmp_path.parent).rglob("scratch-*")} == before


def test_micro_batches_of_any_span_equal_batch(spark, detector, tmp_path):
    names = [f"xk3j9qzb7w{i}x0.net" for i in range(10, 30)]
    rows = [event(0, 60.0 * i, f"10.3.0.{i}", name, "A", 17) for i, name in enumerate(names)]
    # Flows near the end of a batch alert again just after it; one lies ahead of all.
    rows += [event(0, t, "10.3.1.1", names[-1], "A", 17) for t in (1190.0, 1205.0, 1900.0, 2390.0, 2405.0)]
    rows += [event(0, 1210.0 + 70 * i, f"10.3.0.{i}", name, "A", 17) for i, name in enumerate(names[:15])]
    rows += [event(0, 2410.0 + 70 * i, f"10.3.0.{i}", name, "A", 17) for i, name in enumerate(names[:15])]
    # A source that pauses, with a window that is long enough only together with what came before.
    rows += [event(0, t + i, "10.3.2.2", f"q{t}{i}aaaaaaaaaaaaaaaaaaaaaaaaa.tunnel.org", "TXT", 50) for t in (100, 2500) for i in range(12)]
    rows = numbered(sorted(rows, key=lambda r: r[1]))
    wide = Detector(**{**detector.__dict__, "bucket_us": 3_600_000_000})
    folders = Folders(str(tmp_path / "run"))
    for batch, (low, high) in enumerate([(0, 1200), (1200, 2400), (2400, 9999)]):
        feed(spark, folders, wide, batch, as_lines([r for r in rows if low <= r[1] < high]))
    assert run_totals(read_counts(spark, folders))["expired_sources"] == 0
    assert key_rows(read_alerts(spark, folders.alerts)) == key_rows(detect(spark.createDataFrame(rows, EVENT), wide))


def test_alert_ids_are_unique_and_repeat(spark, detector):
    rows = numbered([event(i, 5.0, f"10.0.0.{i % 2}", "xk3j9qzb7w1x0.net", "A", 17) for i in range(6)])
    free = Detector(**{**detector.__dict__, "cooldown_us": None})
    ids = [sorted(r["alert_id"] for r in detect(spark.createDataFrame(rows, EVENT), free).collect()) for _ in range(2)]
    assert len(set(ids[0])) == 6 and ids[0] == ids[1]


def test_ablation(spark, normal_windows, forest):
    odd = normal_windows.limit(60).withColumn("unique_subdomains", F.col("query_rate").cast("double") * 4)
    labelled = odd.withColumn("label", F.lit("normal")).withColumn("tool", F.lit("normal"))
    rates = {r["variant"]: r for r in ab.false_positive_rates(
        odd, forest, ab.median_replacements(normal_windows, forest)).collect()}
    assert set(rates) == {"baseline", *WINDOW_FEATURES} and rates["baseline"]["delta_points"] == 0
    assert rates["unique_subdomains"]["fp_rate"] < rates["baseline"]["fp_rate"]
    revisit = {r["variant"]: r["fp_rate"] for r in ab.false_positive_rates(odd, forest, ab.revisit_replacement("id")).collect()}
    assert revisit["unique_subdomains"] < revisit["baseline"]
    assert evaluate_forest(labelled, forest)["specificity"].first()["fp_rate"] == pytest.approx(rates["baseline"]["fp_rate"])


def test_poisson_and_severity(spark):
    draws = spark.range(4000).select(ab.poisson(2.5, F.lit(1), F.col("id")).alias("k"))
    stats = draws.agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert abs(stats["m"] - 2.5) < 0.15 and abs(stats["v"] - 2.5) < 0.3
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in (0.85, 0.849, 0.6, 0.3, 0.29)], "c double").select(
        severity(F.col("c")).alias("s")).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_totals_of_many_micro_batches(spark):
    rows = [(b, 10, 1, 9, 2, b % 7, 1, 3, 0) for b in range(150)]
    totals = run_totals(spark.createDataFrame(rows, COUNTS))
    assert (totals["lines"], totals["rejected"], totals["alerts"], totals["expired_sources"]) == (1500, 150, 300, 150)
    assert totals["active_sources"] == 149 % 7
