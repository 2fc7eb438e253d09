"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Models are trained first and timed on their own, so that the detection entries measure detection.
"""

import json
import os
import time

from dnsflow.operators.lexical import label_features
from dnsflow.operators.scale import materialize
from dnsflow.operators.windows import window_features
from dnsflow.plans.detect import detect
from dnsflow.queries import catalog
from dnsflow.queries import tables as t
from dnsflow.session import local_session

HEADLINE = (
    "event_validation", "query_response_match", "registrable_domain", "lexical_features", "bigram_score",
    "window_features_all", "hopping_features", "allowlist_filter", "alert_cooldown", "roc_auc", "operating_points",
    "stratified_split", "fixed_sessions", "column_medians", "forest_scores", "classifier_metrics", "detect_batch",
    "detect_stream",
)


def run(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    rows = t.dns_events(spark, sf_dir).count()
    seconds = {"train_models": timed(lambda: catalog.detector(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = timed(lambda: run(catalog.REGISTRY[name](spark, sf_dir)))
    # The operators alone, on tables and lists that are already there.
    detector = catalog.detector(spark, sf_dir)
    events = materialize(t.threat_events(spark, sf_dir))
    names = materialize(t.host_labels(spark, sf_dir))
    labels = names.count()
    seconds["core_label_features"] = timed(lambda: run(label_features(names, detector.lexicon)))
    seconds["core_window_features"] = timed(lambda: run(window_features(events, detector.bucket_us)))
    seconds["core_detect"] = timed(lambda: run(detect(events, detector)))
    print(json.dumps({
        "metric": "headline query wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "events": rows,
        "labels": labels,
        "rows_per_sec": {
            "detect": round(rows / seconds["core_detect"]), "detect_stream": round(rows / seconds["detect_stream"]),
            "window_features": round(rows / seconds["core_window_features"]),
            "label_features": round(labels / seconds["core_label_features"])},
    }))


if __name__ == "__main__":
    main()
