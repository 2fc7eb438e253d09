"""Mixing sources to target weights by capped water-filling.

``source_targets`` shares a budget of words among sources by weight; a source stops at ``most`` times its
size and what it can't take is shared again by weight, until no source is above. ``cuts`` turns targets
into seeded samples: ``floor(target / size)`` whole repetitions plus a fraction, which takes the documents
that come first in the order of a seeded hash. The document at the cut is taken whole or left, whichever is nearer, so each source meets its
target to half a document. ``mix`` applies the cuts to documents.

Only one row per source takes part in the water-filling, and the driver sees sums. The cut is found through sums of
65,536 hash blocks per source, so a source that holds a third of all rows is spread over many tasks; then documents meet one row per source.

Nulls: a null text has no words; null is a source of its own, the last; rows with a null doc_id are told apart by their texts. Rows that
share doc_id and text are taken or left together at the cut. A source without words has the target 0. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm.common import word_count
from dnsflow.operators.scale import materialize, running_totals

SEED = "mix-1"


def order_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``sized`` has the columns source and size. ``weights`` repeat over the sources in code point order.
    """
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = running_totals(
        totals.withColumn("_last", F.col("source").isNull()).withColumn("_one", F.lit(1)),
        ["_last", "source"], {"_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", weight.alias("weight")))
    cap, budget = F.col("source_size") * F.lit(float(most)), None
    level, capped = 0.0, 0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        state = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"), F.sum(full.cast("long")).alias("full")).first()
        budget = share * (state["all"] or 0)
        if budget == 0 or (level > 0 and state["full"] == capped):
            break
        capped = state["full"]
        if not state["free"]:
            level = math.inf
            break
        level = (budget - state["held"]) / state["free"]
    target = cap if level == math.inf else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with whole repetitions and, for the fraction, the place where the hash order is cut.

    ``sized``: source, size, hash. Adds whole, cut_hash, cut_size (null: nothing is cut off) and cut_taken, whether what lies at the cut is taken.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    goals = materialize(
        targets.withColumn("whole", whole).withColumn("rest", F.round("target").cast("long") - F.col("whole") * size))
    goal = goals.select(F.col("source").alias("_source"), "rest")
    same = F.col("source").eqNullSafe(F.col("_source"))
    units = materialize(
        sized.groupBy("source", "hash", "size").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("words", F.col("size") * F.col("copies")).withColumn("block", F.substring("hash", 1, 4)))
    upto = lambda *by: F.sum("words").over(
        Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    crossing = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))
    blocks = (
        units.groupBy("source", "block").agg(F.sum("words").alias("words")).withColumn("upto", upto("block"))
        .join(goal, same).where(crossing)
        .select("source", "block", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")))
    blocks = materialize(blocks)
    of_block = blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "rest")
    at = (
        units.join(of_block, same & (F.col("block") == F.col("_block"))).drop("_source", "_block")
        .withColumn("upto", upto("hash", "size")).where(crossing)
        .select(F.col("source").alias("_source"), F.col("hash").alias("cut_hash"), F.col("size").alias("cut_size"),
                (2 * (F.col("rest") - F.col("upto") + F.col("words")) >= F.col("words")).alias("cut_taken")))
    return materialize(goals.join(at, same, "left").drop("_source", "rest"))


def taken(cut: DataFrame, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
          seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _whole (repetitions), _first (whether there is one more), _part (the words of that one), _source_size and _target."""
    own = cut.select(*[F.col(c).alias(f"_{c}") for c in cut.columns])
    joined = docs.join(own, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_size", word_count(text))
    h = order_hash(F.col(doc_id), F.col(text), seed)
    before = F.col("_cut_hash").isNull() | (h < F.col("_cut_hash")) | (
        (h == F.col("_cut_hash")) & (F.col("_size") < F.col("_cut_size")))
    tie = (h == F.col("_cut_hash")) & (F.col("_size") == F.col("_cut_size")) & F.col("_cut_taken")
    part = F.when(F.col("_first"), F.col("_size")).otherwise(0).cast("long")
    return joined.withColumn("_first", before | tie).withColumn("_part", part).drop(
        "_cut_hash", "_cut_size", "_cut_taken", "_source", "_weight")


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """source, number of words and place in the seeded order of each document, written once."""
    return materialize(docs.select(
        F.col(source).alias("source"), word_count(text).alias("size"), order_hash(F.col(doc_id), F.col(text), seed).alias("hash")))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = SEED) -> DataFrame:
    """The cuts of a mix of ``docs``."""
    sized = sizes(docs, seed=seed)
    return cuts(sized, source_targets(sized, weights, share, most))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: str = SEED) -> DataFrame:
    """The mixed documents, always whole: one row per repetition. Columns are those of ``docs``."""
    named = docs.select(*[F.col(c).alias(f"c_{c}") for c in docs.columns])
    marked = taken(plan(docs, weights, share, most, seed), named, "c_text", "c_doc_id", "c_source", seed)
    times = F.col("_whole") + F.col("_first").cast("long")
    rows = marked.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), times.cast("int"))))
    return rows.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])
