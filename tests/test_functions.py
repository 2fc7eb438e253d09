import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dnsflow.functions.text import basic_features, register_sql_functions, value_entropy
from dnsflow.sources.sinks import write_report

NAMES = ["", "a", "google", "xqzplvmno-8f3ab21", "0123456789abcdef", "yyy", "straße7"]


def test_sql_functions_equal_the_columns(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(n,) for n in NAMES], "label string")
    both = df.select("label", *basic_features(F.col("label")), *[
        F.expr(f"dns_{f}(label)").alias(f"sql_{f}") for f in
        ("label_entropy", "digit_ratio", "vowel_consonant_ratio", "max_consonant_run", "hex_char_ratio")])
    for r in both.collect():
        assert r["sql_label_entropy"] == pytest.approx(r["entropy"])
        for f in ("digit_ratio", "vowel_consonant_ratio", "max_consonant_run", "hex_char_ratio"):
            assert r[f"sql_{f}"] == pytest.approx(r[f]), (r["label"], f)


def test_value_entropy(spark):
    df = spark.createDataFrame([([],), (["A"] * 4,), (["A", "A", "TXT", "NULL"],)], "v array<string>")
    assert [r["e"] for r in df.select(value_entropy(F.col("v")).alias("e")).collect()] == [0.0, 0.0, 1.5]


def test_report_sink(spark, tmp_path):
    report = spark.createDataFrame([("auc", 0.9)], "metric string, value double")
    write_report(report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["value"] == 0.9


def test_nothing_reaches_the_network():
    """The library only reads what it is given."""
    banned = {"socket", "requests", "urllib", "http", "httpx", "aiohttp", "dns", "ftplib", "telnetlib", "ssl"}
    for path in (Path(__file__).resolve().parent.parent / "dnsflow").rglob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else (
                [node.module or ""] if isinstance(node, ast.ImportFrom) else [])
            assert not {n.split(".")[0] for n in names} & banned, path
