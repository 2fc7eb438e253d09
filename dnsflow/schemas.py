"""Column names and schemas shared by the whole package."""

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("qtype", T.StringType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("nxdomain", T.BooleanType()),
    T.StructField("ts_us", T.LongType()),
])

REQUIRED_FIELDS = ("ts", "src_ip", "domain", "qtype", "length")

LEXICAL_FEATURES = (
    "length", "entropy", "digit_ratio", "vowel_consonant_ratio",
    "max_consonant_run", "ngram_score", "dict_word_ratio", "hex_char_ratio",
)

WINDOW_FEATURES = (
    "query_rate", "unique_subdomains", "avg_query_len", "txt_ratio",
    "nxdomain_rate", "non_a_ratio", "record_type_entropy",
)

EVIDENCE = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in LEXICAL_FEATURES]
    + [T.StructField("src_ip", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in WINDOW_FEATURES]
)

ALERT = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("threat_class", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", EVIDENCE),
])

DGA = "DGA"
TUNNELLING = "DNS_TUNNELLING"

MESSAGE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("has_ip", T.BooleanType()),
    T.StructField("has_udp", T.BooleanType()),
    T.StructField("dns_id", T.IntegerType()),
    T.StructField("qr", T.IntegerType()),
    T.StructField("rcode", T.IntegerType()),
    T.StructField("qdcount", T.IntegerType()),
    T.StructField("qname", T.StringType()),
    T.StructField("qtype", T.IntegerType()),
])
