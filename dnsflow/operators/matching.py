"""Match DNS queries to their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dnsflow.operators.scale import lookup_join, materialize, union_all
from dnsflow.sources.events import MAX_TS, valid
from dnsflow.sources.messages import queries, responses

NXDOMAIN_RCODE = 3
KEY = ("dns_id", "src_ip", "src_port")


def _ts_us(ts: Column) -> Column:
    """Microseconds; times beyond what events may have are cut to that, so that intervals can be added."""
    return F.floor(F.least(ts, F.lit(MAX_TS)) * 1_000_000).cast("long")


def matched_events(matched: DataFrame) -> DataFrame:
    """Events of queries with the response code that was found; those that break the rules for events are dropped."""
    events = matched.select(
        "seq", "ts", "src_ip", "domain", "qtype", F.char_length("domain").cast("double").alias("length"),
        F.coalesce(F.col("rcode") == NXDOMAIN_RCODE, F.lit(False)).alias("nxdomain"),
        _ts_us(F.col("ts")).alias("ts_us"))
    return events.where(valid(events))


def match_responses(messages: DataFrame) -> DataFrame:
    """One event per query; the last response with its key decides, unmatched queries are kept."""
    outcome = materialize(responses(messages).groupBy(*KEY).agg(F.max_by("rcode", "seq").alias("rcode")))
    return matched_events(lookup_join(queries(messages), outcome, KEY, "left", spread=["seq"]))


def match_responses_within(messages: DataFrame, within_us: int = 10_000_000) -> DataFrame:
    """As ``match_responses``, but only responses up to ``within_us`` after the query count.

    The last response at or before the end of the interval is carried along time order.
    Both sides are cut into time blocks of the interval length, so keys that are reused for
    days spread over many tasks; responses also go to the following block.
    """
    block = F.expr(f"at div {within_us}L")
    answers = (
        responses(messages).withColumn("at", _ts_us(F.col("ts")))
        .groupBy(*KEY, "at").agg(F.max_by("rcode", "seq").alias("rcode"))
        .select(*KEY, "at", "rcode", F.col("at").alias("answered"),
                F.explode(F.array(block, block + 1)).alias("block"))
    )
    asked = queries(messages).withColumn("ts_us", _ts_us(F.col("ts")))
    ends = (
        asked.select(*KEY, "ts_us").distinct()
        .withColumn("at", F.col("ts_us") + within_us).withColumn("block", block)
    )
    upto = Window.partitionBy(*KEY, "block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    outcome = (
        union_all([ends, answers])
        .withColumn("last", F.max(F.when(F.col("answered").isNotNull(), F.struct("answered", "rcode"))).over(upto))
        .where(F.col("ts_us").isNotNull())
        .select(*KEY, "ts_us", F.when(F.col("last.answered") >= F.col("ts_us"), F.col("last.rcode")).alias("rcode"))
    )
    return matched_events(lookup_join(asked, materialize(outcome), [*KEY, "ts_us"], "left", spread=["seq"]))
