"""Content-addressed WARC archive.

``write_archive`` stores each payload once under its SHA-256 and the exact header bytes of every record
apart from it; ``read_records`` joins both again and gives the original records, after checking each
payload against its digest. Of records with equal payloads (at least ``least`` bytes) the one with the smallest id is
the response, the others revisit it.

Copies are thinned per task before the payloads are shuffled, and records join a table of digests, not of payloads,
so a page that makes up a third of all rows neither moves nor piles up.

Nulls: a null payload is empty; a null id comes last and is written ``null``; a null URL becomes the
record's own id. Rows that repeat the id and payload of a response are responses as well.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsflow.operators.scale import checkpoint_folder

CRLF = "\r\n"
_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Folders of an archive: ``payloads`` (digest, payload, first_id) and ``records`` (id, digest, header)."""

    payloads: str
    records: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: each 10 hex digits are 40 bits, thus 8 digits of base 32."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _RFC32)


def record_header(kind: Column, record_id: Column, refers_to: Column, url: Column, size: Column, digest: Column,
                  date: str) -> Column:
    """WARC header and HTTP header of a record, as they stand in a file."""
    uri = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    target = F.replace(F.replace(F.coalesce(url, uri(record_id)), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
    revisit = kind == "revisit"
    length = F.when(revisit, F.lit(0)).otherwise(size) + len(http)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", uri(record_id)),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(refers_to))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit(CRLF), F.lit(http))


def write_archive(pages: DataFrame, record_id: str = "page_id", url: str = "url", content: str = "html",
                  least: int = 0, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> Archive:
    """Write one record per row of ``pages`` below ``folder`` (default: the checkpoint folder)."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/dnsflow/warc-{uuid.uuid4().hex}"
    archive = Archive(f"{folder}/payloads", f"{folder}/records")
    payload = F.encode(F.coalesce(F.col(content), F.lit("")), "UTF-8")
    own = pages.select(F.col(record_id).alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256))
    first = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last())
    (own.select("digest", "id", "payload").withColumn("_row", F.row_number().over(first)).where("_row = 1")
     .select("digest", "payload", F.col("id").alias("first_id"), F.octet_length("payload").cast("long").alias("bytes"),
             base32_sha1(F.col("payload")).alias("sha1"))
     .write.parquet(archive.payloads))
    known = spark.read.parquet(archive.payloads).select("digest", "first_id", "bytes", "sha1")
    revisits = (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first_id"))
    records = own.select("id", "url", "digest").join(known, "digest").withColumn(
        "kind", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")))
    header = record_header(F.col("kind"), F.col("id"), F.col("first_id"), F.col("url"), F.col("bytes"), F.col("sha1"), date)
    records.select("id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(archive.records)
    return archive


def _payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored payloads; a payload that does not fit its digest ends the read with an error."""
    stored = spark.read.parquet(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return stored.select(checked.alias("digest"), "payload")


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The fields of every record's header, parsed from its bytes: id, kind, sha1, refers_to, url; and its digest."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, f"\r\n{name}: {value}\r\n", 1), F.lit(""))
    return spark.read.parquet(archive.records).select(
        "digest", field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("id"),
        field("WARC-Type", "([a-z]+)").alias("kind"), field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("sha1"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        field("WARC-Target-URI", "([^\r]*)").alias("url"))


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """Size and SHA-1 of each stored payload, computed from its bytes: digest, bytes, sha1."""
    return _payloads(spark, archive).select(
        "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records as they would stand in a WARC file: id, record (header, payload unless a revisit, end)."""
    heads = spark.read.parquet(archive.records)
    revisit = F.decode("header", "UTF-8").contains(f"{CRLF}WARC-Type: revisit{CRLF}")
    return heads.join(_payloads(spark, archive), "digest").select(
        "id", F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(CRLF * 2).cast("binary"))
        .alias("record"))
