import base64
import hashlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dnsflow.llm import warc_store as w

PAGES = "page_id long, url string, html string, kind string"
ROWS = [(3, "http://a/", "same", ""), (1, "http://b/", "same", ""), (2, None, None, ""), (5, "http://c/\r\nX: y", "", ""),
        (7, "http://d/", "ünï 🙂", ""), (None, "http://e/", "same", ""), (1, "http://b/", "same", "")]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def read(spark, archive):
    return w.read_headers(spark, archive).join(w.read_payloads(spark, archive).withColumnRenamed("sha1", "own"), "digest").collect()


def test_records_say_what_was_written(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS, PAGES))
    rows = read(spark, archive)
    assert len(rows) == len(ROWS) and all(r["sha1"] == r["own"] for r in rows)
    got = Counter((r["id"], r["kind"], r["refers_to"], r["bytes"], r["own"]) for r in rows)
    same, empty = sha1("same"), sha1("")
    assert got == Counter([
        (1, "response", None, 4, same), (1, "response", None, 4, same), (3, "revisit", 1, 4, same), (None, "revisit", 1, 4, same),
        (2, "response", None, 0, empty), (5, "revisit", 2, 0, empty), (7, "response", None, len("ünï 🙂".encode()), sha1("ünï 🙂"))])
    assert spark.read.parquet(archive.payloads).count() == 3


def test_small_payloads_are_all_responses(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS, PAGES), least=5)
    assert {r["kind"] for r in read(spark, archive)} == {"response"}


def test_records_are_whole(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS[:2] + ROWS[3:5], PAGES))
    for r in w.read_records(spark, archive).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(lines[b"Content-Length"]) == len(rest) - 4
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert (lines[b"WARC-Type"] == b"revisit") == (r["id"] == 3)
        if r["id"] != 3:
            assert body.decode() == {1: "same", 5: "", 7: "ünï 🙂"}[r["id"]]


def test_damaged_payloads_end_the_read(spark):
    archive = w.write_archive(spark.createDataFrame(ROWS[:1], PAGES))
    bad = w.Archive(archive.payloads + "-bad", archive.records)
    spark.read.parquet(archive.payloads).withColumn("payload", F.lit(b"other")).write.parquet(bad.payloads)
    with pytest.raises(PySparkException):
        w.read_records(spark, bad).collect()


def test_empty_table(spark):
    assert read(spark, w.write_archive(spark.createDataFrame([], PAGES))) == []
