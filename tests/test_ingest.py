import json

import pytest

from dnsflow.operators.matching import match_responses, match_responses_within
from dnsflow.schemas import MESSAGE
from dnsflow.sources.events import accepted, check_events, read_lines, rejected, with_arrival_number
from dnsflow.sources.lists import read_family_domains, read_plain_domains, read_ranked_list, read_suffix_rules, read_words

VALID = {"ts": 12.5, "src_ip": "10.0.0.1", "domain": "example.com", "qtype": "A", "length": 11, "nxdomain": False}


def without(field):
    return {k: v for k, v in VALID.items() if k != field}


BAD = [(json.dumps(without(f)), f"missing required field(s): {f}") for f in ("ts", "src_ip", "domain", "qtype", "length")]
BAD += [(json.dumps(dict(VALID, ts=v)), "ts must be") for v in ("not-a-number", None, [1, 2], -5.0, True)]
BAD += [(json.dumps(dict(VALID, domain=v)), "domain must be") for v in ("", "   ", "\t ", 12345, None)]
BAD += [(json.dumps(dict(VALID, domain="x" * 256)), "domain exceeds max DNS name length: 256 chars")]
BAD += [(json.dumps(dict(VALID, src_ip=v)), "src_ip must be") for v in ("", 12345, None)]
BAD += [(json.dumps(dict(VALID, qtype=v)), "qtype must be") for v in ("", None, 1)]
BAD += [(json.dumps(dict(VALID, length=v)), "length must be") for v in (-1, "twenty", None, False)]
BAD += [(json.dumps(dict(VALID, nxdomain=v)), "nxdomain must be") for v in ("yes", None, 1)]
BAD += [('"a string"', "event is not a JSON object: str"), ("42", "event is not a JSON object: int"),
        ('["list"]', "event is not a JSON object: list"), ("null", "event is not a JSON object: NoneType"),
        ("{not valid json", "invalid JSON"), ('{"ts": NaN}', "invalid JSON"),
        ('{"ts": 1.0, "src_ip": "x"}', "missing required field(s): domain, qtype, length")]
GOOD = [json.dumps(VALID), json.dumps(without("nxdomain")), json.dumps(dict(VALID, qtype="  ")),
        json.dumps(dict(VALID, domain="x" * 255)), json.dumps(dict(VALID, ts=3, length=0.5, extra={"a": 1}))]


@pytest.fixture(scope="module")
def checked(spark):
    lines = [x for x, _ in BAD] + GOOD + ["", "   ", "\t"]
    return check_events(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))


def test_reasons(checked):
    reasons = {r["seq"]: r["reason"] for r in rejected(checked).collect()}
    assert sorted(reasons) == list(range(len(BAD)))
    for i, (line, reason) in enumerate(BAD):
        assert reasons[i].startswith(reason), (line, reasons[i])


def test_accepted_events(checked):
    rows = {r["seq"] - len(BAD): r for r in accepted(checked).collect()}
    assert sorted(rows) == list(range(len(GOOD)))
    assert (rows[0]["ts"], rows[0]["length"], rows[0]["ts_us"], rows[0]["nxdomain"]) == (12.5, 11.0, 12_500_000, False)
    assert rows[1]["nxdomain"] is False
    assert (rows[4]["ts"], rows[4]["length"]) == (3.0, 0.5)


def test_a_bad_line_does_not_stop_the_file(spark, tmp_path):
    good = [json.dumps(dict(VALID, ts=t)) for t in (2.0, 1.0, 1.0, 0.5)]
    (tmp_path / "log.jsonl").write_text("\n".join([*good, "{not valid json", '{"ts": 1.0}', ""]), encoding="utf-8")
    result = check_events(read_lines(spark, str(tmp_path)))
    assert {r["file_name"] for r in rejected(result).collect()} == {"log.jsonl"}
    numbered = sorted((r["seq"], r["ts"]) for r in with_arrival_number(accepted(result)).collect())
    assert numbered == [(1, 0.5), (2, 1.0), (3, 1.0), (4, 2.0)]


def message(seq, ts, src, dst, sport, dport, dns_id, qr, rcode, qname, qtype=1, qdcount=1):
    return (seq, ts, src, dst, sport, dport, True, True, dns_id, qr, rcode, qdcount, qname, qtype)


MESSAGES = [
    message(1, 1000.0, "10.0.0.5", "8.8.8.8", 53001, 53, 1, 0, None, "google.com."),
    message(2, 1000.01, "8.8.8.8", "10.0.0.5", 53, 53001, 1, 1, 0, "google.com."),
    message(3, 1001.0, "203.0.113.7", "8.8.8.8", 53002, 53, 2, 0, None, "deadbeef01234.tunnel.example.net.", 16),
    message(4, 1001.02, "8.8.8.8", "203.0.113.7", 53, 53002, 2, 1, 3, "deadbeef01234.tunnel.example.net.", 16),
    message(5, 1002.0, "10.0.0.9", "8.8.8.8", 53003, 53, 3, 0, None, "orphan-query.example.org."),
    message(6, 1003.0, "10.0.0.5", "8.8.8.8", 53001, 53, 9, 0, None, "..", 1),
    message(7, 1003.0, "10.0.0.5", "8.8.8.8", 53001, 53, 9, 0, None, "no-question.com", 1, 0),
    message(8, 1004.0, "10.0.0.6", "8.8.8.8", 53001, 53, 7, 0, None, "odd.example.org", 999),
    message(9, 1004.1, "8.8.8.8", "10.0.0.6", 53, 53001, 7, 1, 0, "odd.example.org", 999),
    message(10, 1004.2, "8.8.8.8", "10.0.0.6", 53, 53001, 7, 1, 3, "odd.example.org", 999),
    message(11, 2000.0, "8.8.8.8", "10.0.0.9", 53, 53003, 3, 1, 3, "late reuse"),
]


def test_query_response_match(spark):
    got = {r["seq"]: r for r in match_responses(spark.createDataFrame(MESSAGES, MESSAGE)).collect()}
    assert sorted(got) == [1, 3, 5, 8]
    assert (got[1]["domain"], got[1]["qtype"], got[1]["nxdomain"], got[1]["length"]) == ("google.com", "A", False, 10.0)
    assert (got[3]["qtype"], got[3]["nxdomain"]) == ("TXT", True)
    assert got[8]["qtype"] == "999" and got[8]["nxdomain"] is True      # last response wins
    assert got[5]["nxdomain"] is True                                   # no time bound


def test_query_response_match_within(spark):
    got = {r["seq"]: r["nxdomain"] for r in match_responses_within(spark.createDataFrame(MESSAGES, MESSAGE)).collect()}
    assert got == {1: False, 3: True, 5: False, 8: True}


def test_list_files(spark, tmp_path):
    (tmp_path / "psl.dat").write_text("// comment\n\ncom\n!www.ck\n*.ck\nCO.UK\n公司.cn\n", encoding="utf-8")
    rules = {(r["rule"], r["kind"]) for r in read_suffix_rules(spark, str(tmp_path / "psl.dat"), None).collect()}
    assert rules == {("com", "rule"), ("www.ck", "exception"), ("*.ck", "rule"), ("co.uk", "rule"), ("xn--55qx5d.cn", "rule")}
    assert read_suffix_rules(spark, str(tmp_path / "psl.dat")).count() == 5 + 13
    (tmp_path / "top.csv").write_text("1,a.com\n2,\n3,c.com\n4,d.com\n")
    assert [r["domain"] for r in read_ranked_list(spark, str(tmp_path / "top.csv"), 3).collect()] == ["a.com", "c.com"]
    (tmp_path / "plain.txt").write_text("a.com\n 7, b.com \n\nc.com\r\n")
    assert sorted(r["domain"] for r in read_plain_domains(spark, str(tmp_path / "plain.txt")).collect()) == ["a.com", "b.com", "c.com"]
    (tmp_path / "words.txt").write_text("Cloud\n\n at \n")
    assert sorted(r["word"] for r in read_words(spark, str(tmp_path / "words.txt")).collect()) == ["at", "cloud"]
    (tmp_path / "12_zeus_dga.csv").write_text('domain,seen\n"AB.com",1\nab.com,2\nx.net,3,too,many\ny.org,4\n')
    (tmp_path / "3_mirai_v2_dga.csv").write_text("seen,domain\n1,q.com\n")
    (tmp_path / "4_none_dga.csv").write_text("name,seen\nlost.com,1\n")
    got = {(r["domain"], r["family"]) for r in read_family_domains(spark, str(tmp_path / "*_dga.csv")).collect()}
    assert got == {("ab.com", "zeus"), ("y.org", "zeus"), ("q.com", "mirai_v2")}


def test_run_counters(checked):
    from pyspark.sql import Observation

    from dnsflow.sources.sinks import count_run
    seen = Observation("run")
    count_run(checked, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"lines": len(BAD) + len(GOOD), "rejected": len(BAD), "events": len(GOOD)}
