import random

import regex
from pyspark.sql import functions as F

from dnsflow.llm import order_minhash as o


def fingerprints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(o.fingerprint(F.col("text"))).collect()]


def hashes(spark, *values):
    """Spark's hash of each tuple of strings or numbers."""
    columns = [F.xxhash64(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for x in v]).alias(f"h{i}") for i, v in enumerate(values)]
    return list(spark.range(1).select(*columns).first()) if values else []


def model(spark, text):
    """The fingerprint by plain loops."""
    mask = (1 << 64) - 1
    pieces = regex.findall(rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{o.PIECE}}}|[^\p{{L}}\p{{M}}\p{{N}}\s]", text)
    if not pieces:
        return []
    single = hashes(spark, *[(p,) for p in pieces])
    runs = [single[i:i + o.K] for i in range(len(single) - o.K + 1)] or [single]
    kmers = [h >> 24 for h in hashes(spark, *map(tuple, runs))]
    seen, numbered = {}, []
    for k in kmers:
        numbered.append((k, seen.get(k, 0)))
        seen[k] = numbered[-1][1] + 1
    full = spark.range(1).select(*[F.xxhash64(F.lit(k).cast("long"), F.lit(c)).alias(f"h{i}") for i, (k, c) in enumerate(numbered)]).first()
    slots = {}
    for place, value in enumerate(full):
        value = (value & mask) >> 24
        slots.setdefault(value >> 34, []).append((value, place))
    out = {}
    for slot, members in slots.items():
        chosen = sorted(sorted(members)[:o.DEPTH], key=lambda m: m[1])
        array = F.array(*[F.lit((v >> 1)).cast("long") for v, _ in chosen])
        out[slot] = (slot << 16) + (spark.range(1).select(F.xxhash64(array)).first()[0] & 0xFFFF)
    return sorted(out.values())


def test_fingerprints_follow_the_definition(spark):
    draw = random.Random(2)
    texts = ["one", "two words", " ".join(draw.choice(["aa", "bb", "cccccccc", "d,", "é!"]) for _ in range(60)), "same " * 9, "日本語テキスト。"]
    for text, got in zip(texts, fingerprints(spark, texts)):
        assert sorted(got) == model(spark, text)


def test_order_and_repeats_matter(spark):
    words = [f"word{i}" for i in range(200)]
    swapped = words[100:] + words[:100]
    edited = words[:95] + ["new"] * 5 + words[100:]
    a, b, c, a2, twice = fingerprints(spark, [" ".join(w) for w in (words, swapped, edited, words, words + words)])
    like = lambda x, y: len(set(x) & set(y)) / len({v >> 16 for v in x} | {v >> 16 for v in y})
    assert a == a2 and like(a, c) > 0.6
    assert 0.3 < like(a, b) < 0.9        # the same k-mers but for two, in another order
    assert like(a, twice) < 0.9


def test_edges(spark):
    rows = [(3, "c" * 10), (1, None), (2, ""), (7, "xy" * 4), (2, "abcdefgh"), (None, "first of all")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    out = {(r["doc_id"], r["n_chars"]): r for r in o.edit_tail(docs).collect()}
    order = [(None, "first of all"), (1, ""), (2, ""), (2, "abcdefgh"), (3, "c" * 10), (7, "xy" * 4)]
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        n = len(text) // 4
        assert out[i, len(text)]["edited"] == text[:len(text) - n] + following[:n]
    near = {(r["doc_id"], r["n_chars"]): r for r in o.compare_with_edits(docs).collect()}
    assert near[1, 0]["near_next"] == 1.0 and near[1, 0]["near_edited"] == 1.0 and near[2, 0]["near_next"] == 0.0
    assert o.compare_with_edits(docs.limit(0)).count() == 0
    assert o.compare_with_edits(spark.createDataFrame([(5, "only one here")], "doc_id long, text string")).first()["near_next"] == 1.0


def test_repeated_rows_and_very_long_text(spark):
    long = " ".join(str(i % 1000) for i in range(100_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x")], "doc_id long, text string")
    rows = o.compare_with_edits(docs).orderBy("doc_id").collect()
    assert len(rows) == 3 and rows[0] == rows[1] and [r["near_next"] for r in rows] == [0.0] * 3
    assert 0.2 < rows[0]["near_edited"] < 1
