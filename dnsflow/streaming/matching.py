"""Match queries and responses that arrive as one message stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.matching import KEY, matched_events
from dnsflow.sources.messages import queries, responses

LAST_TIME = 253_402_300_799     # timestamps end with the year 9999


def match_responses_stream(messages: DataFrame, within: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Left outer stream join on the key and a time range; of several responses the last one decides.

    A query is emitted once the watermark passes its interval.
    """
    time = lambda df: F.timestamp_micros(F.floor(df["ts"] * 1_000_000).cast("long"))
    timely = messages.where(F.col("ts").between(0, LAST_TIME))
    asked, answered = queries(timely), responses(timely)
    q = asked.withColumn("asked_at", time(asked)).withWatermark("asked_at", delay).alias("q")
    r = answered.withColumn("answered_at", time(answered)).withWatermark("answered_at", delay).select(
        *[F.col(k).alias(f"r_{k}") for k in KEY], "answered_at", F.col("seq").alias("r_seq"), "rcode").alias("r")
    same = [F.col(f"q.{k}") == F.col(f"r.r_{k}") for k in KEY]
    in_time = (F.col("answered_at") >= F.col("asked_at")) & (
        F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {within}"))
    condition = same[0] & same[1] & same[2] & in_time
    matched = q.join(r, condition, "left_outer").groupBy(
        F.window("asked_at", "1 second"), "seq", "ts", "src_ip", "domain", "qtype").agg(
        F.max(F.struct("answered_at", "r_seq", "rcode")).alias("last"))
    return matched_events(matched.withColumn("rcode", F.col("last.rcode")))
