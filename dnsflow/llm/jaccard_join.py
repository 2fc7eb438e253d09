"""N-gram Jaccard join by partitioning the universe of shingles, with exact verification.

Two sets of sizes r <= s with a Jaccard similarity of at least p differ in at most (1 - p) / (1 + p) (r + s) elements and
are in the same or in neighbouring size bands. (``Rule``: five words and 80 %, unless a caller says otherwise.) For each band a hash deals all shingles into segments; by the pigeonhole principle, two
similar sets agree on whole segments, up to as many credits as the scheme holds beyond the differences allowed. A segment
that must agree exactly is one credit and costs one signature; a segment that may differ in one element is two credits and
costs one signature per element more (its one-deletion neighbourhood, read off the sum that hashes the segment). ``scheme`` allocates by these costs:
neighbourhoods alone where few segments are needed, so that segments stay large; else exact segments, and neighbourhoods for a few. Small subsets (up to
``SMALL`` shingles) would collide in many texts: they are not indexed, as far as spare credits cover them in a set; a set with more of them leaves out
the empty ones, or indexes all.

Equal sets share a 64-bit digest and are one node (digests of n different sets clash with a probability of n^2 / 2^65). Copies within a task send their
signatures once. A signature's sets are verified against one of them, the one that shares most signatures, so a group of n near copies costs n
verifications and not n^2. Where that leaves sets of one signature in different components, a link between them has to show in what tells both from
the centre: ``_remaining`` joins those differences, again by a pigeonhole. No candidate is dropped.

Signatures, compared texts and differences are many times what is kept of them. Beyond ``PASS_ROWS`` signatures these are shuffled in up to ``PARTS``
passes; beyond four times as many, the others in up to half as many passes. Rows are dealt by a hash of what they are joined on; a pass's shuffles go
before the next one starts.

Nulls: a null text has no shingles; such texts and empty ones are linked with nothing. A null doc_id takes part, but never names a component;
a component without any id has null. Rows that share a doc_id and a text are one; with different texts they are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm.common import unused
from dnsflow.llm.components import components
from dnsflow.operators.scale import materialize, release, union_all

SMALL = 1   # subsets of up to so many shingles are left out where credits allow
PARTS = 8   # columns that a set's signatures are dealt to, and the most passes
PASS_ROWS = 20_000_000  # signatures a pass, while there are fewer than PARTS

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _times(n: int) -> np.uint64:
    return np.uint64(n * int(_MIX[0]) % (1 << 64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z lowered; a word ends at white space in ASCII."""
    import xxhash

    if not text:
        return np.zeros(0, np.uint64)
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.encode().lower().split())), "<u8")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of ``size`` words, in text order; one of the whole sequence if it is shorter, none if it is empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, _times(width))
    for i in range(width):
        total = mix(total ^ words[i:len(words) - width + 1 + i]) + np.uint64(i)
    return total


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), size))


def digest(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets are linked from ``percent`` on, in per cent."""

    words: int = 5
    percent: int = 80

    def linked(self, common: int, size: int, other: int) -> bool:
        return 100 * common >= self.percent * (size + other - common)

    def allowed(self, size: int, other: int) -> int:
        """In how many elements linked sets of these sizes differ at most."""
        return (100 - self.percent) * (size + other) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return 100 * size // self.percent

    @cached_property
    def first_size(self) -> int:
        """Sets that are smaller can only be linked with equal ones."""
        size = 1
        while self.allowed(size, self.largest_partner(size)) < 1:
            size += 1
        return size

    @cached_property
    def _starts(self) -> list[int]:
        return [self.first_size]

    def band_start(self, band: int) -> int:
        """Smallest size in a band; the sizes that may be linked with a set are in its band or in a neighbouring one."""
        while len(self._starts) <= band:
            self._starts.append(self.largest_partner(self._starts[-1]) + 1)
        return self._starts[band]

    def band_of(self, size: int) -> int:
        band = 0
        while self.band_start(band + 1) <= size:
            band += 1
        return band

    def scheme(self, band: int) -> tuple[int, int, int]:
        """(segments, segments with neighbourhoods, spare credits) for pairs whose smaller set is in ``band``."""
        largest = self.band_start(band + 1) - 1
        differences = self.allowed(largest, self.largest_partner(largest))
        if differences < 8:
            segments = near = (differences + 2) // 2
        else:
            segments, near = differences + 2 + -(-differences // 16), 1
        return segments, near, segments + near - differences


def scheme_signatures(shingles: np.ndarray, band: int, rule: Rule) -> np.ndarray:
    segments, near, spare = rule.scheme(band)
    salt = _times(band + 1)
    spread = mix(shingles ^ salt)
    own = ((spread >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    value = mix(spread + _MIX[0])
    order = np.argsort(own, kind="stable")
    own, value = own[order].astype(np.int64), value[order]
    sizes = np.bincount(own, minlength=segments)
    ends = np.cumsum(sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    totals = sums[ends] - sums[ends - sizes]
    place = np.arange(segments, dtype=np.uint64) * _MIX[1] + salt
    is_near = np.arange(segments) < near
    lost = lambda small: (sizes[~is_near] <= small).sum() + 2 * (sizes[is_near] <= small + 1).sum()
    least = next((small + 1 for small in range(SMALL, -1, -1) if lost(small) < spare), 0)
    whole = mix(totals + place)[sizes >= least]
    inside = is_near[own] & (sizes[own] - 1 >= least)
    fewer = mix(totals[own[inside]] - value[inside] + place[own[inside]])
    return np.unique(np.concatenate([whole, fewer]))


def signatures(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """Signatures of a set: as the smaller set of a pair in its own band, and as the larger one for the band below."""
    if len(shingles) < rule.first_size:
        return np.zeros(0, np.int64)
    band = rule.band_of(len(shingles))
    parts = [scheme_signatures(shingles, b, rule) for b in (band, band - 1) if b >= 0]
    return np.concatenate(parts).view(np.int64)


def _ids(docs: DataFrame) -> DataFrame:
    """doc_id, text, a hash of it and a key that is never null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).withColumn(
        "key", F.coalesce("doc_id", "text_key"))


def _dealt(flat: np.ndarray, sizes: list[int]) -> pa.StructArray:
    """Lists of these sizes, each dealt to ``PARTS`` by the last bits of its values."""
    n, part = len(sizes), flat & (PARTS - 1)
    counts = np.bincount(part * n + np.repeat(np.arange(n), sizes), minlength=PARTS * n).reshape(PARTS, n)
    values = np.split(flat[np.argsort(part.astype(np.uint8), kind="stable")], np.cumsum(counts.sum(axis=1))[:-1])
    lists = [pa.ListArray.from_arrays(np.cumsum([0, *c], dtype=np.int32), pa.array(v, pa.int64())) for v, c in zip(values, counts)]
    return pa.StructArray.from_arrays(lists, [f"p{i}" for i in range(PARTS)])


def _index(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, text_key, doc_id, n_shingles, node and, for the first row of a set in a task, its signatures (``n_sigs`` of them)."""
    def run(batches):
        seen = set()
        for batch in batches:
            sizes, nodes, found = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), rule.words)
                node = digest(shingles)
                sizes.append(len(shingles))
                nodes.append(node)
                found.append(signatures(shingles, rule) if node not in seen else np.zeros(0, np.int64))
                seen.add(node)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            counts = [*map(len, found)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "text_key", "doc_id")), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(counts, pa.int64()), _dealt(flat, counts)],
                ["key", "text_key", "doc_id", "n_shingles", "node", "n_sigs", "sigs"])

    parts = ", ".join(f"p{i}: array<long>" for i in range(PARTS))
    return _ids(docs).mapInArrow(
        run, f"key long, text_key long, doc_id long, n_shingles long, node long, n_sigs long, sigs struct<{parts}>")


def _passes(rows: int) -> int:
    """1, 2, 4 and so on up to ``PARTS``."""
    return next((n for n in (1 << i for i in range(PARTS.bit_length())) if n == PARTS or rows <= n * PASS_ROWS))


def _shared(signed: DataFrame, passes: int) -> DataFrame:
    """sig, node, k: the signatures that different sets have, and in how many rows. A pass reads and shuffles its part of the signatures."""
    whole, found = Window.partitionBy("sig"), []
    for n in range(passes):
        own = F.concat(*[F.col(f"sigs.p{i}") for i in range(n, PARTS, passes)])
        found.append(materialize(
            signed.select("node", F.explode(own).alias("sig"))
            .withColumn("least", F.min("node").over(whole)).withColumn("most", F.max("node").over(whole))
            .withColumn("k", F.count(F.lit(1)).over(whole)).where("least != most")
            .groupBy("sig", "node").agg(F.max("k").alias("k"))))
        release(signed.sparkSession)
    return union_all(found)


def _texts(docs: DataFrame, index: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text of each of ``nodes``: node, text. Its shingles are computed again where sets are compared: they would take three times its space."""
    wanted = index.select("node", "key", "text_key").join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("key", "text_key")).alias("row")).select("node", "row.*")
    # Rows may come more than once; so would every pair of their sets.
    return _ids(docs).join(wanted, ["key", "text_key"]).groupBy("key", "text_key").agg(
        F.first("node").alias("node"), F.min("text").alias("text")).select("node", "text")


def _in_pass(df: DataFrame, column: str, n: int, passes: int) -> DataFrame:
    return df if passes == 1 else df.where(F.pmod(F.xxhash64(column), F.lit(passes)) == n)


def _beside(
    pairs: DataFrame, texts: DataFrame, u: str, v: str, passes: int, compare: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What ``compare`` makes of ``pairs`` of nodes with their texts: u, v, a, b. The rows of a ``v`` mostly follow one another.

    Written in passes over ``u``: each shuffles its share of the texts ``a`` and those texts that are ``b`` of any pair.
    """
    others = texts if passes == 1 else materialize(texts.join(pairs.select(F.col(v).alias("node")).distinct(), "node", "left_semi"))
    right, found = others.select(F.col("node").alias(v), F.col("text").alias("b")), []
    for n in range(passes):
        left = _in_pass(texts, "node", n, passes).select(F.col("node").alias(u), F.col("text").alias("a"))
        found.append(materialize(compare(_in_pass(pairs, u, n, passes).join(left, u).join(right, v).select(u, v, "a", "b"))))
        release(texts.sparkSession)
    if passes > 1:
        release(texts.sparkSession, others)
    return union_all(found)


def _both_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Batches of ``_beside`` with the shingles of both texts of each row."""
    last, other = None, None

    def sets(batch):
        nonlocal last, other
        for node, a, b in zip(batch.column(1).to_pylist(), batch.column("a"), batch.column("b")):
            if node != last or other is None:
                last, other = node, shingle_set(b.as_py(), words)
            yield shingle_set(a.as_py(), words), other

    for batch in batches:
        yield batch, sets(batch)


def _linked(pairs: DataFrame, texts: DataFrame, rule: Rule, passes: int = 1) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    def run(batches):
        for batch, sets in _both_sets(batches, rule.words):
            keep = [rule.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in sets]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, texts, "u", "v", passes, lambda both: both.mapInArrow(run, "u long, v long").distinct())


def _compared(tried: DataFrame, texts: DataFrame, rule: Rule, passes: int = 1) -> DataFrame:
    """For each (node, centre): whether they are linked, the node's size, in how many shingles they differ, and the first of these.

    ``firsts`` has as many of the differing shingles as ``_remaining`` may need, hashed with the centre: those that only the node has, then
    those that only the centre has, each in ascending order.
    """
    def run(batches):
        for batch, sets in _both_sets(batches, rule.words):
            rows, firsts = [], []
            for centre, (a, b) in zip(batch.column("centre").to_pylist(), sets):
                added, removed = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                common = len(a) - len(added)
                linked = rule.linked(common, len(a), len(b))
                most = rule.allowed(len(a), rule.largest_partner(len(a))) + 1
                salt = mix(np.array([centre], np.int64).view(np.uint64))
                firsts.append(mix(np.concatenate([added, removed])[:most] ^ salt).view(np.int64))
                rows.append((linked, len(a), len(added) + len(removed)))
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, firsts)], dtype=np.int32), pa.array(flat, pa.int64()))
            linked, size, apart = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("centre"), pa.array(linked, pa.bool_()), pa.array(size, pa.int64()),
                 pa.array(apart, pa.int64()), lists], ["node", "centre", "linked", "size", "apart", "firsts"])

    return _beside(tried, texts, "node", "centre", passes, lambda both: both.mapInArrow(
        run, "node long, centre long, linked boolean, size long, apart long, firsts array<long>"))


def _remaining(compared: DataFrame, labels: DataFrame, rule: Rule, passes: int = 1) -> DataFrame:
    """Pairs (u, v) around one centre that may be linked though not yet in one component.

    Relative to their centre, u and v differ in |U| + |V| - 2 |U and V| shingles, where U and V are what tells each from the centre. So a link
    needs |U and V| >= (|U| + |V| - allowed) / 2: in any common order of the shingles, U and V then share one among their first
    |U| - that + 1 and |V| - that + 1. The order puts shingles that the centre lacks first: edits of different copies seldom share any,
    so few pairs are left of n^2. |U| and |V| differ by no more than allowed, which bounds how many first ones are needed.
    """
    spark = compared.sparkSession
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label"))
    members = materialize(
        compared.select("node", "centre").join(of("node"), "node", "left").join(of("centre"), "centre", "left")
        .withColumn("label", F.coalesce("node_label", "node"))
        .select("node", "centre", "label", (F.col("label") != F.coalesce("centre_label", "centre")).alias("outside")))
    mixed = members.where("outside").select("centre").distinct()
    placed = materialize(members.join(mixed, "centre", "left_semi"))
    same = Window.partitionBy("key")
    side = lambda rows, n: rows.select("key", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "label", "size", "apart", "place")])
    allowed = F.expr(f"({100 - rule.percent} * (u_size + v_size)) div {100 + rule.percent}")
    possible = (
        (F.col("u_label") != F.col("v_label")) & (100 * F.least("u_size", "v_size") >= rule.percent * F.greatest("u_size", "v_size"))
        & (2 * F.col("u_place") <= F.col("u_apart") - F.col("v_apart") + allowed)
        & (2 * F.col("v_place") <= F.col("v_apart") - F.col("u_apart") + allowed))
    found = []
    for n in range(passes):     # over centres, with which the shingles are hashed
        rows = _in_pass(placed, "centre", n, passes).join(
            _in_pass(compared.select("node", "centre", "size", "apart", "firsts"), "centre", n, passes), ["node", "centre"]).select(
            "node", "label", "outside", "size", "apart", F.posexplode("firsts").alias("place", "key"))
        shared = materialize(
            rows.withColumn("least", F.min("label").over(same)).withColumn("most", F.max("label").over(same))
            .withColumn("any", F.max("outside").over(same)).where("least != most and any").drop("least", "most", "any"))
        release(spark)
        found.append(materialize(_pairs("u_node", "v_node", side(shared.where("outside"), "u").join(side(shared, "v"), "key").where(possible))))
        release(spark, shared)
    rest = materialize(union_all(found).distinct().join(_pairs("node", "centre", compared), ["u", "v"], "left_anti"))
    release(spark, members, placed, *found)
    return rest


def _pairs(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()


def _labelled(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, text_key, doc_id, n_shingles, label of every row; equal labels are linked, if there are shingles."""
    spark = docs.sparkSession
    signed = materialize(_index(docs, rule))
    rows = signed.agg(F.sum("n_sigs")).first()[0] or 0
    shared, passes = _shared(signed, _passes(rows)), min(PARTS // 2, _passes(rows // 4))
    index = materialize(signed.drop("sigs", "n_sigs"))
    release(spark, signed)
    texts = materialize(_texts(docs, index, shared.select("node").distinct()))
    release(spark)
    # The set that shares most signatures, and those of the largest groups, is the likeliest to be near all others.
    weights = shared.groupBy("node").agg(F.sum("k").alias("weight"))
    centres = shared.join(weights, "node").withColumn("centre", F.max(F.struct("weight", "node")).over(Window.partitionBy("sig"))["node"])
    tried = materialize(centres.select("node", "centre").where("node != centre").distinct())
    release(spark, shared)
    compared = _compared(tried, texts, rule, passes)
    links = compared.where("linked").select(F.col("node").alias("u"), F.col("centre").alias("v"))
    near = materialize(components(links))
    release(spark, tried)       # not before the components: only then does nothing hold the comparison's shuffles any more
    rest = _remaining(compared, near, rule, passes)
    release(spark, compared)
    joined = near.select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = materialize(components(joined.unionByName(_linked(rest, texts, rule, passes))))
    release(spark, texts, rest, near)
    return index.select("key", "text_key", "doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "key", "text_key", "doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are not read)."""
    own = _labelled(docs, rule)
    first = own.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("first"))
    return own.join(first, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The document with the smallest id of each component (one without an id only if there is none), and all without shingles.

    Columns are those of ``docs``, whatever their names.
    """
    own = materialize(_labelled(docs, rule))
    key_, text_, once, copy_ = unused(docs.columns, "_key", "_text", "_once", "_copy")
    # Rows that share an id may hold different texts, of different components: a document is its key and its text.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "key", "text_key"))
    kept = own.where("n_shingles > 0").groupBy("label").agg(best.alias("best")).select(
        F.col("best.key").alias(key_), F.col("best.text_key").alias(text_), F.lit(True).alias(once))
    free = own.where("n_shingles = 0").select(F.col("key").alias(key_), F.col("text_key").alias(text_), F.lit(False).alias(once)).distinct()
    chosen = materialize(kept.unionByName(free))
    text = F.xxhash64("text")
    key = F.coalesce(F.col("doc_id").cast("long"), text)
    copy = F.row_number().over(Window.partitionBy(key_, text_).orderBy("text"))
    return docs.withColumn(key_, key).withColumn(text_, text).join(chosen, [key_, text_]).withColumn(copy_, copy).where(
        ~F.col(once) | (F.col(copy_) == 1)).select(*docs.columns)
