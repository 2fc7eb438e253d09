"""Labelled tables: cleaning, capping, balancing, shuffling, splitting, sessions.

Random choices follow the MD5 order of a key and a seed, so they repeat on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.text import value_entropy
from dnsflow.operators.scale import hash_key, hash_rank, lookup_join, materialize

FAMILY_CAP = 5000
BENIGN = "benign"
# Label codes, and queries per session.
TOOLS = {0: "normal", 1: "dns2tcp", 2: "dnscapy", 3: "iodine", 4: "tuns"}
SESSION_SIZES = {"normal": 12, "dns2tcp": 40, "dnscapy": 40, "iodine": 40, "tuns": 40}
A_CODE, TXT_CODE = 1, 16
N_SESSIONS = 416


def clean_domains(df: DataFrame, column: str = "domain") -> DataFrame:
    """Distinct, trimmed, lowercased names."""
    return df.select(F.lower(F.trim(column)).alias("domain")).where(F.col("domain").isNotNull()).distinct()


def union_domains(lists: Sequence[DataFrame]) -> DataFrame:
    """Distinct union of domain lists."""
    out = lists[0].select("domain")
    for other in lists[1:]:
        out = out.unionByName(other.select("domain"))
    return out.distinct()


def cap_per_group(df: DataFrame, group: str, key: str, cap: int = FAMILY_CAP, seed: int = 42) -> DataFrame:
    """At most ``cap`` random rows per group; ``key`` is unique within the group."""
    return hash_rank(df, key, seed, [group], at_most=cap).drop("rank")


def labelled_domains(dga: DataFrame, benign: DataFrame) -> DataFrame:
    """``(domain, label, family)`` from ``(domain, family)`` and benign names."""
    return dga.select("domain", F.lit(1).alias("label"), "family").unionByName(
        benign.select("domain", F.lit(0).alias("label"), F.lit(BENIGN).alias("family")))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random rows of ``df``."""
    return hash_rank(df, key, seed, at_most=n).drop("rank")


def balance(dga: DataFrame, benign: DataFrame, seed: int = 42) -> tuple[DataFrame, int]:
    """Labelled table with as many benign as generated names, and the shortfall of benign ones."""
    wanted = dga.count()
    available = benign.count()
    return labelled_domains(dga, random_rows(benign, "domain", wanted, seed)), max(wanted - available, 0)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(key, seed), key)


def stratified_split(df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first ``ceil(share * n)`` rows of each label in hash order."""
    ranked = hash_rank(df, key, seed, [label], size="_size")
    return ranked.withColumn("is_test", F.col("rank") <= F.ceil(F.col("_size") * F.lit(test_share))).drop("rank", "_size")


def benign_sample(df: DataFrame, key: str, share: float = 0.3, seed: int = 1) -> DataFrame:
    ranked = hash_rank(df.where(F.col("family") == BENIGN), key, seed, size="_size")
    return ranked.where(F.col("rank") <= F.round(F.col("_size") * F.lit(share))).drop("rank", "_size")


def leave_one_out(
    df: DataFrame, family: str, key: str = "domain", share: float = 0.3, seed: int = 1, disjoint_benign: bool = True,
    held: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train without ``family``; test on it and a share of the benign rows.

    With ``disjoint_benign`` the benign test rows leave the training set. ``held``: the written ``benign_sample``, where several families share it.
    """
    given = held is not None
    held = held if given else benign_sample(df, key, share, seed)
    train = df.where(F.col("family") != family)
    if disjoint_benign:
        held = held if given else materialize(held)
        train = lookup_join(train, held.select(key), [key], "left_anti")
    return train, df.where(F.col("family") == family).unionByName(held)


def families(df: DataFrame) -> DataFrame:
    return df.where(F.col("family") != BENIGN).select("family").distinct().orderBy("family")


def tool_name(code: Column) -> Column:
    pairs = [F.lit(x) for pair in TOOLS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))


def _session_features(chunks: DataFrame, session: Sequence[str]) -> DataFrame:
    """Seven features per session; sessions are of bounded size, so their record types fit an array."""
    n = F.count(F.lit(1))
    return chunks.groupBy(*session).agg(
        n.alias("query_rate"),
        F.size(F.collect_set("qname")).cast("double").alias("unique_subdomains"),
        F.avg("qd_qname_len").alias("avg_query_len"),
        F.avg((F.col("qd_qtype") == TXT_CODE).cast("double")).alias("txt_ratio"),
        F.lit(0.0).alias("nxdomain_rate"),
        F.avg((F.col("qd_qtype") != A_CODE).cast("double")).alias("non_a_ratio"),
        value_entropy(F.collect_list("qd_qtype")).alias("record_type_entropy"),
    )


def fixed_sessions(
    rows: DataFrame, key: str, sizes: dict[str, int] | None = None, seed: int = 42
) -> DataFrame:
    """Shuffle the queries of each tool, cut them into sessions of fixed size, drop the remainder.

    ``rows``: ``(tool, qname, qd_qname_len, qd_qtype)`` and a unique ``key``.
    """
    sizes = sizes or SESSION_SIZES
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    ranked = hash_rank(rows, key, seed, ["tool"], size="_size").withColumn(
        "_k", F.try_element_at(size, F.col("tool"))).where(F.col("_k").isNotNull())
    whole = ranked.withColumn("session", F.floor((F.col("rank") - 1) / F.col("_k"))).where(
        (F.col("session") + 1) * F.col("_k") <= F.col("_size"))
    return _session_features(whole, ["tool", "session"]).withColumn(
        "label", F.when(F.col("tool") == "normal", "normal").otherwise("tunnel"))


def _draw(low: int, high: Column | int, *parts: Column) -> Column:
    """Integer in ``low .. high`` from the MD5 of the parts, which other engines reproduce."""
    high = F.lit(high) if isinstance(high, int) else high
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), high - low + 1) + low


def bootstrap_sessions(
    pool: DataFrame, key: str, n_sessions: int = N_SESSIONS, favourites: tuple[int, int] = (2, 5),
    sizes: tuple[int, int] = (8, 20), seed: int = 42,
) -> DataFrame:
    """Sessions drawn with replacement from a few distinct favourite rows of the pool each.

    The favourites of a session are equally spaced ranks of the shuffled pool, hence distinct.
    """
    ranked = materialize(hash_rank(pool, key, seed))
    n = ranked.count()
    spark = pool.sparkSession
    s, salt = F.col("session"), F.lit(seed)
    sessions = spark.range(n_sessions).withColumnRenamed("id", "session").select(
        "session",
        F.least(_draw(*favourites, salt, s, F.lit("f")), F.lit(n)).alias("n_favourites"),
        _draw(*sizes, salt, s, F.lit("n")).alias("size"),
        _draw(0, n - 1, salt, s, F.lit("start")).alias("start"),
        _draw(1, max((n - 1) // favourites[1], 1), salt, s, F.lit("step")).alias("step"))
    draws = sessions.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size")))).withColumn(
        "pick", _draw(0, F.col("n_favourites") - 1, salt, s, F.col("draw"), F.lit("pick"))).select(
        "session", (F.pmod(F.col("start") + F.col("pick") * F.col("step"), F.lit(n)) + 1).alias("rank"))
    return _session_features(draws.join(ranked, "rank"), ["session"]).select(
        "*", F.lit("normal").alias("label"), F.lit("normal_realistic").alias("tool"))
