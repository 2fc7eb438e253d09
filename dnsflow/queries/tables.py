"""DNS-shaped views over the supplied test tables. The SQL twins are in ``oracles.py``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000    # the test events are sparse: one-hour buckets, twelve of them
EXTRA = 10_000_000         # keeps line numbers of different tables apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain"))


def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per event; its name is the host of page ``event_id mod number of pages``."""
    pages = hosts(spark, sf_dir)
    n = max(pages.count(), 1)
    ts_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    qtype = F.expr("""case event_type when 'view' then 'A' when 'click' then 'AAAA' when 'purchase' then 'TXT'
                      when 'signup' then 'CNAME' else 'NULL' end""")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % n).alias("page_id"), ts_us.alias("ts_us"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"), qtype.alias("qtype"),
        (F.col("event_type") == "error").alias("nxdomain"), "value")
    return events.join(pages, "page_id").select(
        "seq", (F.col("ts_us") / 1_000_000).alias("ts"), "src_ip", "domain", "qtype",
        F.char_length("domain").cast("double").alias("length"), "nxdomain", "ts_us", "value")


def threat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, where failing queries ask for random-looking names."""
    random_name = F.concat(F.substring(F.md5(F.col("seq").cast("string")), 1, 12), F.lit(".net"))
    domain = F.when(F.col("nxdomain"), random_name).otherwise(F.col("domain"))
    return dns_events(spark, sf_dir).withColumn("domain", domain).withColumn(
        "length", F.char_length("domain").cast("double"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines of all events, some with seeded defects, and all conversation texts as raw lines."""
    e = dns_events(spark, sf_dir)
    kind = F.col("seq") % 20
    text = lambda s: F.lit(s)
    seconds = F.expr("ts_us div 1000000").cast("string")
    ts = F.when(kind == 1, text('"soon"')).when(kind == 2, text("-5")).when(kind == 3, text("null")).otherwise(seconds)
    ip = F.when(kind == 4, text("17")).when(kind == 5, text('"  "')).otherwise(
        F.concat(text('"'), F.col("src_ip"), text('"')))
    domain = F.when(kind == 6, F.concat(text('"'), F.repeat(F.lit("x"), 256), text('"'))).when(
        kind == 7, text("null")).otherwise(F.concat(text('"'), F.col("domain"), text('"')))
    qtype = F.when(kind == 8, text('""')).otherwise(F.concat(text('"'), F.col("qtype"), text('"')))
    length = F.when(kind == 9, text("true")).when(kind == 10, text("-1")).otherwise(
        F.char_length("domain").cast("string"))
    nx = F.when(kind == 11, text("null")).when(kind == 12, text('"yes"')).otherwise(
        F.when(F.col("nxdomain"), "true").otherwise("false"))
    head = F.when(kind == 13, text("{")).when(kind == 14, text("[{")).otherwise(
        F.concat(text('{"ts": '), ts, text(", ")))
    tail = F.when(kind == 14, text("}]")).when(kind == 15, text("")).otherwise(text("}"))
    src = F.when(kind == 16, text("")).otherwise(F.concat(text('"src_ip": '), ip, text(", ")))
    line = F.concat(head, src, text('"domain": '), domain, text(', "qtype": '), qtype, text(', "length": '), length,
                    F.when(kind == 17, text("")).otherwise(F.concat(text(', "nxdomain": '), nx)), tail)
    raw = table(spark, sf_dir, "conversations").select(
        (EXTRA + F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("value"))
    return e.select("seq", line.alias("value")).unionByName(raw)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query message per event, and a response for all but CNAME queries; keys are reused over time."""
    e = dns_events(spark, sf_dir)
    both = e.withColumn("qr", F.explode(F.when(F.col("qtype") == "CNAME", F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))))
    answer = F.col("qr") == 1
    code = F.expr("case qtype when 'A' then 1 when 'AAAA' then 28 when 'TXT' then 16 when 'CNAME' then 5 else 4711 end")
    port = (F.lit(53_000) + F.col("seq") % 7).cast("int")
    return both.select(
        (F.col("seq") * 2 + F.col("qr")).alias("seq"),
        ((F.col("ts_us") + F.col("qr") * 20_000) / 1_000_000).alias("ts"),
        F.when(answer, "8.8.8.8").otherwise(F.col("src_ip")).alias("src_ip"),
        F.when(answer, F.col("src_ip")).otherwise(F.lit("8.8.8.8")).alias("dst_ip"),
        F.when(answer, F.lit(53)).otherwise(port).alias("src_port"),
        F.when(answer, port).otherwise(F.lit(53)).alias("dst_port"),
        F.lit(True).alias("has_ip"), F.lit(True).alias("has_udp"), (F.col("seq") % 3).cast("int").alias("dns_id"),
        "qr", F.when(answer, F.when(F.col("nxdomain"), 3).otherwise(0)).alias("rcode"), F.lit(1).alias("qdcount"),
        F.concat(F.col("domain"), F.lit("..")).alias("qname"), code.alias("qtype"))


def suffix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a suffix file made of the hosts: plain rules, wildcards, exceptions, comments."""
    h = hosts(spark, sf_dir).select("domain").distinct()
    last = lambda n: F.expr(f"array_join(slice(split(domain, '[.]'), -{n}, {n}), '.')")
    line = F.explode(F.array_compact(F.array(
        last(1), F.upper(last(1)), F.when(last(2) == "example.net", last(2)),
        F.when(last(2) == "example.org", F.concat(F.lit("*."), last(2))),
        F.when(F.col("domain").startswith("www.") & (last(2) == "example.org"), F.concat(F.lit("!"), F.col("domain"))),
        F.concat(F.lit("// "), F.col("domain")), F.lit(""))))
    return h.select(line.alias("value"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lowercased words of all documents: the word list."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{Nd}]+)"), 1))
    return table(spark, sf_dir, "documents").select(words.alias("word")).distinct()


def host_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of every host, and every word: names to featurize."""
    labels = hosts(spark, sf_dir).select(F.explode(F.split("domain", "[.]")).alias("label"))
    return labels.unionByName(tokens(spark, sf_dir).select(F.col("word").alias("label"))).distinct()


def popular_hosts(spark: SparkSession, sf_dir: str, n: int = 25) -> DataFrame:
    """The most frequent hosts: the popularity list."""
    return hosts(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "domain").limit(n).select("domain")


def generated_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-looking names made of document hashes: hex labels or letters only, one family per source."""
    digest = F.md5("text")
    letters = F.translate(F.substring(digest, 1, 14), "0123456789", "ghijklmnop")
    hexes = F.concat(F.substring(digest, 1, 12))
    label = F.when(F.col("source").isin("src0", "src1"), hexes).otherwise(letters)
    return table(spark, sf_dir, "documents").select(
        F.concat(label, F.lit(".net")).alias("domain"), F.col("source").alias("family")).distinct()


def benign_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of all words, and the hosts."""
    words = tokens(spark, sf_dir).select(F.concat("word", F.lit(".com")).alias("domain"))
    return words.unionByName(hosts(spark, sf_dir).select("domain")).distinct()


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with an arithmetic score that leans towards the label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    p = ((F.col("n_chars") * 37 + F.col("doc_id") * 101) % 700 + F.col("label") * 300) / 1000
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "label", p.alias("p"), (p >= 0.5).cast("int").alias("predicted"))


def tunnel_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-query rows of five tools, by user."""
    code = F.expr("case qtype when 'A' then 1 when 'AAAA' then 28 when 'TXT' then 16 when 'CNAME' then 5 else 10 end")
    user = F.expr("cast(substring(src_ip, 8) as bigint)")
    return dns_events(spark, sf_dir).select(
        "seq", (user % 5).cast("int").alias("label"), F.col("domain").alias("qname"),
        F.char_length("domain").alias("qd_qname_len"), code.alias("qd_qtype"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round to a number of digits that both engines reproduce."""
    named = set(columns)
    return df.select(*[F.round(c, digits).alias(c) if c in named else F.col(c) for c in df.columns])


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
