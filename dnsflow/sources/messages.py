"""Decoded DNS messages (one row per query or response packet) as input of the matching join."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow.schemas import MESSAGE

# Assigned record-type numbers.
RECORD_TYPES = {
    1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL",
    11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 28: "AAAA",
    29: "LOC", 33: "SRV", 35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 41: "OPT", 42: "APL", 43: "DS",
    44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3",
    51: "NSEC3PARAM", 52: "TLSA", 55: "HIP", 59: "CDS", 60: "CDNSKEY", 64: "SVCB", 65: "HTTPS", 99: "SPF",
    249: "TKEY", 250: "TSIG", 255: "ALL", 257: "CAA",
}


def read_messages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGE).format(format).load(path)


def responses(messages: DataFrame) -> DataFrame:
    """Responses keyed by the client they answer."""
    return messages.where("qr = 1 and has_ip and has_udp").select(
        "seq", "ts", "dns_id", F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"), "rcode")


def queries(messages: DataFrame) -> DataFrame:
    """Queries with a name: first question, no trailing dots, record type by name or else by number."""
    names = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    return (
        messages.where("qr = 0 and qdcount > 0 and has_ip and has_udp")
        .withColumn("domain", F.rtrim("qname", F.lit(".")))
        .where("domain <> ''")
        .select("seq", "ts", "dns_id", "src_ip", "src_port", "domain",
                F.coalesce(F.try_element_at(names, F.col("qtype")), F.col("qtype").cast("string")).alias("qtype"))
    )
