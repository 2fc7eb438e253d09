"""Queries over the supplied tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dnsflow.functions.text import basic_features
from dnsflow.operators import alerts as al
from dnsflow.operators import ablation as ab
from dnsflow.operators import allowlist, cooldown, datasets, evaluation, lexical, matching, suffix, windows
from dnsflow.operators.classifier import evaluate_classifier, held_out_families, score_names, train_classifier
from dnsflow.operators.forest import NODE_SCHEMA, Forest, grow_trees, train_forest
from dnsflow.operators.scale import checkpoint_folder, hash_rank, lookup_join, materialize, running_totals, union_all
from dnsflow.plans import detect as dt
from dnsflow.plans import train as tr
from dnsflow.queries import tables as t
from dnsflow.schemas import TUNNELLING, WINDOW_FEATURES
from dnsflow.sources import events as ev
from dnsflow.sources import lists, sinks
from dnsflow.streaming import detect as streaming

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

_RATES = [f for f in WINDOW_FEATURES if f != "query_rate"]
COOLDOWN_US = 48 * t.HOUR_US


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# --- ingest ---

@query
def event_validation(spark, sf_dir):
    clean = ev.accepted(ev.check_events(t.event_lines(spark, sf_dir)))
    return clean.select("seq", "ts", "src_ip", "domain", "qtype", "length", "nxdomain")


@query
def event_rejects(spark, sf_dir):
    return ev.rejected(ev.check_events(t.event_lines(spark, sf_dir))).select("seq", "raw", "reason")


@query
def event_log_scan(spark, sf_dir):
    """Events of a JSON-lines log in files, which hold the same lines."""
    path = f"{checkpoint_folder(spark)}/dnsflow/lines-{uuid.uuid4().hex}"
    t.event_lines(spark, sf_dir).select("value").write.text(path)
    clean = ev.accepted(ev.check_events(ev.read_lines(spark, path)))
    return clean.select("ts", "src_ip", "domain", "qtype", "length", "nxdomain")


@query
def rejected_lines(spark, sf_dir):
    """Rejects of a log in several files with the line they stand on, counted over all files, which hold the log one after the other."""
    path = f"{checkpoint_folder(spark)}/dnsflow/numbered-{uuid.uuid4().hex}"
    log = t.event_lines(spark, sf_dir).withColumn("value", F.translate("value", "\n\r", "  "))
    log.repartitionByRange(7, "seq").sortWithinPartitions("seq").select("value").write.text(path)
    lines = materialize(ev.read_numbered_lines(spark, path))
    files = lines.groupBy("file_name").agg(F.max("line").alias("lines"))
    earlier = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)     # one row a file
    before = files.select("file_name", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    bad = ev.rejected(ev.check_events(lines)).join(F.broadcast(before), "file_name")
    return bad.select((F.col("before") + F.col("line")).alias("line"), "raw", "reason")


@query
def run_counters(spark, sf_dir):
    """Lines, rejects and events of an ingest run, observed while it is written."""
    seen = Observation(f"run-{uuid.uuid4().hex}")
    sinks.count_run(ev.check_events(t.event_lines(spark, sf_dir)), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["lines"], seen.get["rejected"], seen.get["events"])], "lines long, rejected long, events long")


@query
def message_filter(spark, sf_dir):
    """Matching where messages lack IP, UDP, a question or a name, and some names are too long to be valid."""
    seq = F.col("seq")
    damaged = t.messages(spark, sf_dir).withColumns({
        "has_ip": seq % 11 != 0, "has_udp": seq % 13 != 0, "qdcount": F.when(seq % 17 == 0, 0).otherwise(F.col("qdcount")),
        "qname": F.when(seq % 19 == 0, F.lit(None)).when(seq % 23 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("qname"))})
    return matching.match_responses(damaged).drop("ts")


def _ranks(hosts):
    """rank, domain: hosts by falling number of rows, then by name."""
    counts = hosts.groupBy("domain").agg((-F.count(F.lit(1))).alias("_less"), F.lit(1).alias("_one"))
    return running_totals(counts, ["_less", "domain"], {"rank": "_one"}).select("rank", "domain")


@query
def ranked_list(spark, sf_dir):
    """The first ten ranks of a popularity list in a file."""
    path = f"{checkpoint_folder(spark)}/dnsflow/ranks-{uuid.uuid4().hex}"
    _ranks(t.hosts(spark, sf_dir)).write.csv(path)
    return lists.read_ranked_list(spark, path, 10)


@query
def query_response_match(spark, sf_dir):
    return matching.match_responses(t.messages(spark, sf_dir)).drop("ts")


@query
def query_response_interval(spark, sf_dir):
    return matching.match_responses_within(t.messages(spark, sf_dir), 12 * t.HOUR_US).drop("ts")


# --- windows ---

@query
def window_features(spark, sf_dir):
    features = windows.window_features(t.dns_events(spark, sf_dir), t.HOUR_US)
    return t.rounded(features.where(F.col("query_rate") >= al.MIN_QUERIES), *_RATES)


@query
def window_features_all(spark, sf_dir):
    return t.rounded(windows.window_features(t.dns_events(spark, sf_dir), t.HOUR_US), *_RATES)


@query
def hopping_features(spark, sf_dir):
    return t.rounded(windows.hopping_features(t.dns_events(spark, sf_dir), t.HOUR_US), *_RATES)


@query
def window_features_at(spark, sf_dir):
    """Features a day after each source's first query: most windows have moved on."""
    e = t.dns_events(spark, sf_dir)
    probes = e.groupBy("src_ip").agg((F.min("ts_us") + 24 * t.HOUR_US).alias("ts_us"))
    return t.rounded(windows.features_at(e, probes, t.HOUR_US), *_RATES)


@query
def window_unique_sketch(spark, sf_dir):
    """Two names in a bucket already promote it, so that estimates occur; small sketches are near-exact."""
    names = windows.unique_names(t.dns_events(spark, sf_dir), t.HOUR_US, promote_above=1)
    return t.rounded(names, "unique_subdomains", digits=0)


@query
def idle_keys(spark, sf_dir):
    return windows.idle_sources(t.dns_events(spark, sf_dir), ttl_us=24 * t.HOUR_US)


# --- names ---

@query
def suffix_rules(spark, sf_dir):
    return lists.suffix_rules(t.suffix_lines(spark, sf_dir), lists.EXTRA_SUFFIXES)


def _rules(spark, sf_dir):
    return materialize(suffix_rules(spark, sf_dir))


@query
def registrable_domain(spark, sf_dir):
    return suffix.registrable_names(t.hosts(spark, sf_dir), _rules(spark, sf_dir))


@query
def lexical_basic(spark, sf_dir):
    labels = t.host_labels(spark, sf_dir)
    features = labels.select("label", *basic_features(F.col("label")))
    return t.rounded(features, *[c for c in features.columns if c != "label"])


@query
def bigram_model(spark, sf_dir):
    return t.rounded(lexical.bigram_model(t.tokens(spark, sf_dir)), "prob", digits=9)


def _word_features(spark, sf_dir):
    words = materialize(t.tokens(spark, sf_dir))
    return lexical.word_features(t.host_labels(spark, sf_dir), lexical.lexicon(words))


@query
def bigram_score(spark, sf_dir):
    return t.rounded(_word_features(spark, sf_dir).select("label", "ngram_score"), "ngram_score")


@query
def dictionary_coverage(spark, sf_dir):
    return t.rounded(_word_features(spark, sf_dir).select("label", "dict_word_ratio"), "dict_word_ratio")


def _totals(features):
    """Labels and exact sums of each feature, in millionths, per label length: all labels, few rows."""
    names = [c for c in features.columns if c != "label"]
    millionths = lambda c: F.round(F.col(c) * 1_000_000).cast("long")
    return features.groupBy(F.char_length("label").alias("n_chars")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(millionths(c)).alias(c) for c in names])


@query
def lexical_totals(spark, sf_dir):
    return _totals(lexical_basic(spark, sf_dir))


@query
def bigram_totals(spark, sf_dir):
    return _totals(bigram_score(spark, sf_dir))


@query
def dictionary_totals(spark, sf_dir):
    return _totals(dictionary_coverage(spark, sf_dir))


@query
def lexical_features(spark, sf_dir):
    """All eight features per host, through the registrable label."""
    lex = lexical.lexicon(materialize(t.tokens(spark, sf_dir)))
    out = lexical.domain_features(t.hosts(spark, sf_dir), _rules(spark, sf_dir), lex)
    return t.rounded(out.drop("suffix_length", "registrable_domain"),
                     *[c for c in out.columns if c not in ("domain", "registrable_label")])


# --- allowlist ---

def _named_events(spark, sf_dir):
    rules = _rules(spark, sf_dir)
    events = t.dns_events(spark, sf_dir)
    names = materialize(suffix.registrable_names(events, rules).select("domain", "registrable_domain"))
    allowed = allowlist.popular_domains(t.popular_hosts(spark, sf_dir), rules)
    return lookup_join(events, names, ["domain"], "inner", spread=["seq"]), allowed


@query
def allowlist_filter(spark, sf_dir):
    named, allowed = _named_events(spark, sf_dir)
    return allowlist.suppress(named, allowed).select("seq", "src_ip", "domain", "registrable_domain")


@query
def allowlist_coverage(spark, sf_dir):
    named, allowed = _named_events(spark, sf_dir)
    return t.rounded(allowlist.coverage(named, allowed, "qtype"), "share")


# --- alerts ---

def _window_alerts(spark, sf_dir):
    """Alerts for windows of two queries and more, with a decision that falls with rate and TXT share."""
    features = windows.window_features(t.dns_events(spark, sf_dir), t.HOUR_US).where(F.col("query_rate") >= 2)
    decision = 0.25 - F.col("query_rate") / 10 - F.col("txt_ratio") / 2
    return al.tunnelling_alerts(
        features.withColumn("decision", decision).withColumn("ts", F.col("ts_us") / 1_000_000))


@query
def alert_envelope(spark, sf_dir):
    a = _window_alerts(spark, sf_dir).select(
        "alert_id", "timestamp", "flow_id", "threat_class", "severity", "confidence", "seq",
        *[F.col(f"evidence.{f}").alias(f) for f in WINDOW_FEATURES],
        F.col("evidence.entropy").isNull().alias("no_lexical_evidence"))
    return t.rounded(a, "confidence", *WINDOW_FEATURES)


@query
def dga_alert_envelope(spark, sf_dir):
    """Name alerts with a score that is the digit and hex share of the name."""
    e = t.dns_events(spark, sf_dir)
    names = e.select("domain").distinct().select(
        "domain", *[c for c in basic_features(F.col("domain"))],
        F.lit(-5.0).alias("ngram_score"), F.lit(0.25).alias("dict_word_ratio"))
    scored = lookup_join(e.drop("length"), materialize(names), ["domain"], "inner", spread=["seq"]).withColumn(
        "prob", F.least(F.col("hex_char_ratio") * 1.5 + F.col("digit_ratio"), F.lit(1.0)))
    a = al.dga_alerts(scored).select(
        "alert_id", "seq", "timestamp", "flow_id", "threat_class", "severity", "confidence", F.col("evidence.src_ip").alias("src_ip"),
        F.col("evidence.entropy").alias("entropy"), F.col("evidence.length").alias("length"),
        F.col("evidence.query_rate").isNull().alias("no_window_evidence"))
    return t.rounded(a, "confidence", "entropy")


@query
def severity_counts(spark, sf_dir):
    return al.count_by(_window_alerts(spark, sf_dir), "severity")


@query
def class_counts(spark, sf_dir):
    """Alert counts by class, read back from the JSON alert log."""
    path = f"{checkpoint_folder(spark)}/dnsflow/alert-log-{uuid.uuid4().hex}"
    sinks.write_alerts(al.public_columns(_window_alerts(spark, sf_dir)), path)
    return al.count_by(sinks.read_alerts(spark, path), "threat_class")


@query
def alert_log(spark, sf_dir):
    log = al.alert_log(_window_alerts(spark, sf_dir))
    return t.rounded(log.withColumn("time_us", F.unix_micros("time")).drop("time"), "confidence")


@query
def first_alert_per_flow(spark, sf_dir):
    first = al.first_alert_per_flow(_window_alerts(spark, sf_dir))
    return t.rounded(first.select("flow_id", "seq", "timestamp", "severity", "confidence"), "confidence")


@query
def alert_cooldown(spark, sf_dir):
    raw = t.dns_events(spark, sf_dir).select(
        F.lit(TUNNELLING).alias("threat_class"), F.col("src_ip").alias("flow_id"), "ts_us", "seq")
    return cooldown.apply_cooldown(raw, COOLDOWN_US)


# --- evaluation ---

@query
def confusion(spark, sf_dir):
    return evaluation.confusion_matrix(t.scored_documents(spark, sf_dir))


@query
def class_report(spark, sf_dir):
    return t.rounded(evaluation.classification_report(t.scored_documents(spark, sf_dir)), "precision", "recall", "f1")


@query
def report_sink(spark, sf_dir):
    """The class report, written as JSON and read back."""
    report, path = class_report(spark, sf_dir), f"{checkpoint_folder(spark)}/dnsflow/report-{uuid.uuid4().hex}"
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def roc_auc(spark, sf_dir):
    return t.rounded(evaluation.roc_auc(t.scored_documents(spark, sf_dir)), "auc")


@query
def brier(spark, sf_dir):
    return t.rounded(evaluation.brier_score(t.scored_documents(spark, sf_dir)), "brier")


@query
def pr_curve(spark, sf_dir):
    return t.rounded(evaluation.precision_recall_curve(t.scored_documents(spark, sf_dir)), "precision", "recall")


@query
def severity_tiers(spark, sf_dir):
    return t.rounded(evaluation.severity_tiers(t.scored_documents(spark, sf_dir)), "precision", "recall_at_or_above")


@query
def operating_points(spark, sf_dir):
    return t.rounded(evaluation.operating_points(t.scored_documents(spark, sf_dir)), "precision", "recall")


@query
def reliability(spark, sf_dir):
    return t.rounded(evaluation.reliability_table(t.scored_documents(spark, sf_dir)), "mean_predicted", "observed")


@query
def group_recall(spark, sf_dir):
    return t.rounded(evaluation.group_recall(t.scored_documents(spark, sf_dir), "source"), "recall")


@query
def specificity(spark, sf_dir):
    return t.rounded(evaluation.specificity(t.scored_documents(spark, sf_dir)), "fp_rate", "specificity")


@query
def nearest_rank_latency(spark, sf_dir):
    return evaluation.nearest_rank(t.table(spark, sf_dir, "events"), "value")


@query
def nearest_rank_of_batches(spark, sf_dir):
    """The same from value counts that sixteen batches of the events leave one after the other."""
    events = materialize(t.table(spark, sf_dir, "events").select("event_id", "value"))
    left = [evaluation.value_counts(events.where(F.col("event_id") % 16 == batch), "value") for batch in range(16)]
    return evaluation.nearest_rank_of_counts(materialize(union_all(left)), "value")


@query
def nearest_rank_by_group(spark, sf_dir):
    return evaluation.nearest_rank(t.table(spark, sf_dir, "events"), "value", group=["event_type"])


@query
def column_medians(spark, sf_dir):
    return t.rounded(evaluation.medians(
        t.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "median")


@query
def column_quantile(spark, sf_dir):
    return t.rounded(evaluation.quantile(t.table(spark, sf_dir, "events"), "value", 0.02), "quantile")


@query
def describe_columns(spark, sf_dir):
    return t.rounded(evaluation.describe(t.dns_events(spark, sf_dir), ["length", "value"]), "mean", "min", "max")


@query
def throughput(spark, sf_dir):
    return t.rounded(evaluation.throughput(t.dns_events(spark, sf_dir)), "elapsed_s", "per_second", "mean_value")


# --- datasets ---

@query
def domain_union(spark, sf_dir):
    hosts = datasets.clean_domains(t.hosts(spark, sf_dir))
    return datasets.union_domains([
        hosts, t.generated_domains(spark, sf_dir), t.benign_domains(spark, sf_dir)])


@query
def family_cap(spark, sf_dir):
    return datasets.cap_per_group(t.generated_domains(spark, sf_dir), "family", "domain", 40)


def _labelled(spark, sf_dir):
    return materialize(datasets.labelled_domains(t.generated_domains(spark, sf_dir), t.benign_domains(spark, sf_dir)))


@query
def balanced_set(spark, sf_dir):
    table, _ = datasets.balance(
        materialize(t.generated_domains(spark, sf_dir)), materialize(t.benign_domains(spark, sf_dir)))
    return table


@query
def shuffled_set(spark, sf_dir):
    """Position of every labelled name in the seeded permutation."""
    return hash_rank(_labelled(spark, sf_dir).select("domain").distinct(), "domain", 42, rank="position")


@query
def stratified_split(spark, sf_dir):
    return datasets.stratified_split(_labelled(spark, sf_dir), "domain")


@query
def leave_one_out_split(spark, sf_dir):
    train, test = datasets.leave_one_out(_labelled(spark, sf_dir), "src1")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def family_list(spark, sf_dir):
    return datasets.families(_labelled(spark, sf_dir))


@query
def label_family_counts(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("label", "family").agg(F.count(F.lit(1)).alias("n"))


def _sessions(spark, sf_dir):
    rows = t.tunnel_queries(spark, sf_dir)
    return datasets.fixed_sessions(rows.withColumn("tool", datasets.tool_name(F.col("label"))), "seq")


@query
def fixed_sessions(spark, sf_dir):
    return t.rounded(_sessions(spark, sf_dir), *_RATES)


@query
def tool_signatures(spark, sf_dir):
    out = evaluation.feature_means(
        _sessions(spark, sf_dir), ["avg_query_len", "txt_ratio", "non_a_ratio", "record_type_entropy"], ["label", "tool"])
    return t.rounded(out, "avg_query_len", "txt_ratio", "non_a_ratio", "record_type_entropy")


@query
def bootstrap_sessions(spark, sf_dir):
    pool = t.tunnel_queries(spark, sf_dir).where("label = 0")
    return t.rounded(datasets.bootstrap_sessions(pool, "seq"), *_RATES)


# --- models ---

_shared: dict[tuple, object] = {}


def _once(spark, sf_dir, name, build):
    """Models and tables that several queries of a session use."""
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _shared:
        _shared[key] = build()
    return _shared[key]


def _lexicon(spark, sf_dir):
    return _once(spark, sf_dir, "lexicon", lambda: lexical.lexicon(materialize(t.tokens(spark, sf_dir))))


def _featurized(spark, sf_dir):
    return _once(spark, sf_dir, "featurized", lambda: tr.featurized(
        _labelled(spark, sf_dir), _rules(spark, sf_dir), _lexicon(spark, sf_dir)))


def _split(spark, sf_dir):
    return _once(spark, sf_dir, "split", lambda: materialize(
        datasets.stratified_split(_featurized(spark, sf_dir), "domain")))


def _classifier(spark, sf_dir):
    return _once(spark, sf_dir, "classifier", lambda: train_classifier(
        _split(spark, sf_dir).where("not is_test")))


def _windows(spark, sf_dir):
    return _once(spark, sf_dir, "windows", lambda: materialize(
        windows.window_features(materialize(t.threat_events(spark, sf_dir)), t.HOUR_US)))


def _forest(spark, sf_dir) -> Forest:
    """Trained on the windows that are long enough to be scored."""
    return _once(spark, sf_dir, "forest", lambda: train_forest(
        _windows(spark, sf_dir).where(F.col("query_rate") >= al.MIN_QUERIES), "seq"))


def detector(spark, sf_dir) -> dt.Detector:
    rules = _once(spark, sf_dir, "rules", lambda: _rules(spark, sf_dir))
    return dt.Detector(
        rules, _lexicon(spark, sf_dir), _classifier(spark, sf_dir), _forest(spark, sf_dir),
        allowlist=_once(spark, sf_dir, "allowed", lambda: allowlist.popular_domains(
            t.popular_hosts(spark, sf_dir), rules)),
        cooldown_us=24 * t.HOUR_US, bucket_us=t.HOUR_US)


@query
def classifier_scores(spark, sf_dir):
    test = _split(spark, sf_dir).where("is_test")
    return score_names(_classifier(spark, sf_dir), test).select("domain", "label", "family", "prob")


@query
def classifier_metrics(spark, sf_dir):
    return evaluate_classifier(_classifier(spark, sf_dir), _split(spark, sf_dir).where("is_test"))


@query
def family_holdout(spark, sf_dir):
    """Every family held out by itself, with the full model."""
    return held_out_families(_featurized(spark, sf_dir))


@query
def forest_scores(spark, sf_dir):
    return _forest(spark, sf_dir).score(_windows(spark, sf_dir)).select("seq", "src_ip", "decision")


@query
def forest_flags(spark, sf_dir):
    """Windows with enough queries by flag."""
    enough = _windows(spark, sf_dir).where(F.col("query_rate") >= al.MIN_QUERIES)
    scored = _forest(spark, sf_dir).score(enough)
    return scored.groupBy((F.col("decision") < 0).alias("flagged")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("query_rate").alias("mean_rate"))


def _session_forest(spark, sf_dir):
    """Sessions of the five tools, bootstrap sessions, and a forest trained on the latter."""
    def build():
        sessions = materialize(_sessions(spark, sf_dir))
        pool = t.tunnel_queries(spark, sf_dir).where("label = 0")
        realistic = materialize(datasets.bootstrap_sessions(pool, "seq"))
        return sessions, realistic, train_forest(realistic, "session")
    return _once(spark, sf_dir, "session_forest", build)


@query
def holdout_report(spark, sf_dir):
    """Detector trained on realistic normal sessions, judged on them and the tunnel sessions."""
    sessions, realistic, forest = _session_forest(spark, sf_dir)
    return tr.evaluate_forest(tr.realistic_holdout(realistic, sessions), forest)["report"]


@query
def holdout_per_tool(spark, sf_dir):
    sessions, realistic, forest = _session_forest(spark, sf_dir)
    return tr.evaluate_forest(tr.realistic_holdout(realistic, sessions), forest)["per_tool"]


@query
def feature_ablation(spark, sf_dir):
    """False-positive rate of fixed normal sessions with each feature set to the training median."""
    sessions, realistic, forest = _session_forest(spark, sf_dir)
    return ab.false_positive_rates(sessions.where("label = 'normal'"), forest, ab.median_replacements(realistic, forest))


@query
def counterfactual(spark, sf_dir):
    """The same with a realistic number of distinct names, and the verdict."""
    sessions, _, forest = _session_forest(spark, sf_dir)
    rates = ab.false_positive_rates(sessions.where("label = 'normal'"), forest, ab.revisit_replacement("session"))
    rate = lambda v: F.max(F.when(F.col("variant") == v, F.col("fp_rate")))
    return rates.agg(rate("baseline").alias("baseline_fp_rate"), rate("unique_subdomains").alias("revisit_fp_rate")).select(
        "*", evaluation.verdict(F.col("baseline_fp_rate"), F.col("revisit_fp_rate")).alias("verdict"))


@query
def plain_list_files(spark, sf_dir):
    """Domains of list files with and without ranks, and words of a word file, counted."""
    base = f"{checkpoint_folder(spark)}/dnsflow/lists-{uuid.uuid4().hex}"
    pages = t.hosts(spark, sf_dir)
    ranked = F.concat(F.col("page_id").cast("string"), F.lit(", "), F.col("domain"), F.lit("\r"))
    pages.select(F.when(F.col("page_id") % 2 == 0, ranked).otherwise(F.concat(F.lit("  "), "domain")).alias("value")).write.text(f"{base}/domains")
    t.tokens(spark, sf_dir).select(F.concat(F.lit(" "), "word", F.lit("\t")).alias("value")).write.text(f"{base}/words")
    domains = lists.read_plain_domains(spark, f"{base}/domains").select(F.lit("domain").alias("kind"), F.col("domain").alias("entry"))
    words = lists.read_words(spark, f"{base}/words").select(F.lit("word").alias("kind"), F.col("word").alias("entry"))
    return domains.unionByName(words).groupBy("kind", F.char_length("entry").alias("n_chars")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entry").alias("n_different"), F.min("entry").alias("first"), F.max("entry").alias("last"))


@query
def fixed_ablation(spark, sf_dir):
    """False-positive rate of a given forest over all windows, as measured and with each feature set to its median."""
    features = materialize(windows.window_features(materialize(t.threat_events(spark, sf_dir)), t.HOUR_US))
    forest = _fixed_forest(spark)
    return t.rounded(ab.false_positive_rates(features, forest, ab.median_replacements(features, forest)), "fp_rate", "delta_points")


@query
def forest_nodes(spark, sf_dir):
    """Nodes of ten trees over 64 windows each, drawn by MD5 from the windows after every event."""
    features = t.rounded(windows.window_features(materialize(t.dns_events(spark, sf_dir)), t.HOUR_US), *_RATES)
    per_tree = materialize(features.select(
        F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree"), "seq", *WINDOW_FEATURES).withColumn(
        "draw", F.concat(F.col("tree").cast("string"), F.lit("-"), F.col("seq").cast("string"))))
    sampled = hash_rank(per_tree, "draw", "forest", ["tree"], at_most=64)
    return grow_trees(sampled, WINDOW_FEATURES, 64).withColumn(
        "threshold", F.when(F.col("left") == F.col("node"), F.lit(-1.0)).otherwise(F.col("threshold")))


# --- detection by fixed rules, which SQL can repeat ---

#: Two small trees over (query_rate, txt_ratio) and avg_query_len: tree, node, feature, threshold, left, right, depth, size.
_FIXED_NODES = [
    (0, 0, 0, 6.0, 1, 2, 0, 8), (0, 1, 0, float("inf"), 1, 1, 1, 6), (0, 2, 3, 0.25, 3, 4, 1, 2),
    (0, 3, 0, float("inf"), 3, 3, 2, 1), (0, 4, 0, float("inf"), 4, 4, 2, 1),
    (1, 0, 2, 15.5, 1, 2, 0, 8), (1, 1, 0, float("inf"), 1, 1, 1, 5), (1, 2, 0, float("inf"), 2, 2, 1, 3),
]


def _fixed_forest(spark) -> Forest:
    return Forest(spark.createDataFrame(_FIXED_NODES, NODE_SCHEMA), sample=8, offset=-0.48)


def _fixed_detector(spark, sf_dir) -> dt.Detector:
    score = F.least(F.col("hex_char_ratio") * 0.75 + F.col("digit_ratio"), F.lit(1.0))
    return dt.Detector(
        _rules(spark, sf_dir), lexical.lexicon(materialize(t.tokens(spark, sf_dir))), score, _fixed_forest(spark),
        cooldown_us=24 * t.HOUR_US, bucket_us=t.HOUR_US)


@query
def fixed_forest_scores(spark, sf_dir):
    """Decisions of a small given forest for all windows."""
    features = windows.window_features(materialize(t.threat_events(spark, sf_dir)), t.HOUR_US)
    return t.rounded(_fixed_forest(spark).score(features).select("seq", "src_ip", "decision"), "decision", digits=9)


@query
def detect_fixed_batch(spark, sf_dir):
    """All alerts after the cooldown, by a given forest and a given name score."""
    alerts = dt.detect(materialize(t.threat_events(spark, sf_dir)), _fixed_detector(spark, sf_dir))
    return t.rounded(alerts.select("seq", *_ALERT), "confidence", digits=9)


@query
def detect_fixed_stream(spark, sf_dir):
    """The same through the streaming path, from JSON lines in files."""
    return t.rounded(_streamed(spark, sf_dir, _fixed_detector(spark, sf_dir)), "confidence", digits=9)


def _streamed(spark, sf_dir, by: dt.Detector) -> DataFrame:
    base = f"{checkpoint_folder(spark)}/dnsflow/stream-{uuid.uuid4().hex}"
    lines = t.threat_events(spark, sf_dir).select(
        F.to_json(F.struct("seq", "ts", "src_ip", "domain", "qtype", "length", "nxdomain")).alias("value"))
    lines.write.text(f"{base}/in")
    folders = streaming.detect_stream(spark, f"{base}/in", base, by)
    return sinks.read_alerts(spark, folders.alerts).select(*_ALERT)


@query
def late_events(spark, sf_dir):
    """On-time and late events of micro-batches, per source at most a day behind; a seventh of the events arrives a batch or more too late."""
    own = materialize(t.dns_events(spark, sf_dir).select("seq", "src_ip", "ts_us"))
    low, high = own.agg(F.min("ts_us"), F.max("ts_us")).first()
    batch = F.expr(f"((ts_us - {low or 0}L) * 8) div {max((high or 0) - (low or 0), 0) + 1}L")
    arrived = materialize(own.withColumn("batch", F.when(F.col("seq") % 7 == 3, F.least(batch + F.col("seq") % 5, F.lit(7))).otherwise(batch)))
    newest, marked = spark.createDataFrame([], streaming.SOURCES), []
    for number in range(8):
        now = arrived.where(F.col("batch") == number)
        marked.append(materialize(streaming.mark_late(now, newest, 24 * t.HOUR_US)))
        newest = materialize(newest.select("src_ip", "at").unionByName(now.select("src_ip", F.col("ts_us").alias("at")))
                             .groupBy("src_ip").agg(F.max("at").alias("at")))
    return union_all(marked).groupBy("batch").agg(
        F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("late"), 1)).alias("late"),
        F.sum(F.when(F.col("late"), F.col("seq")).otherwise(0)).cast("long").alias("late_seqs"))


# --- detection ---

_ALERT = ("timestamp", "flow_id", "threat_class", "severity", "confidence")


@query
def detect_batch(spark, sf_dir):
    alerts = dt.detect(materialize(t.threat_events(spark, sf_dir)), detector(spark, sf_dir))
    return alerts.select("seq", *_ALERT).orderBy("timestamp", "seq", "threat_class")


@query
def detect_stream(spark, sf_dir):
    """The same events as JSON lines through the streaming path."""
    return _streamed(spark, sf_dir, detector(spark, sf_dir))
