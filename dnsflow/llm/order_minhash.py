"""Order MinHash fingerprints of whole texts, in DataFrame operations alone.

A text is cut into pieces: runs of up to ``PIECE`` letters, marks and digits, and single other characters; white
space only separates. A k-mer is ``k`` neighbouring pieces (all of them, if the text has fewer), numbered among
its equals in text order. One hash of (k-mer, number) puts it into one of ``slots`` slots and ranks it there; a slot keeps its
``depth`` smallest, puts them back into text order and hashes that tuple. Moving text changes the tuples even
where the set of k-mers stays, so equal slots speak of a small edit distance and not only of a common vocabulary.

Everything happens inside the row, in arrays: two sorts of longs per text and no shuffle. A long packs 40 bits of hash
with 24 bits of position; pieces after the first 16,777,215 share that position (their order falls back on the hash).

Nulls: a null text is empty. An empty fingerprint (no pieces) is like another empty one (1.0) and unlike any
other (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.llm.common import let, successors
from dnsflow.operators.scale import materialize

PIECE, K, SLOTS, DEPTH = 6, 3, 64, 2
_PLACE = (1 << 24) - 1
_SLOT_BITS = 6          # SLOTS = 2 ** _SLOT_BITS


def _packed(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place)


def _kmers(text: Column) -> Column:
    """Hash and place of every k-mer, packed."""
    pattern = rf"[\p{{L}}\p{{M}}\p{{N}}]{{1,{PIECE}}}|[^\p{{L}}\p{{M}}\p{{N}}\s]"
    hashes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.xxhash64(p))

    def all_of(h: Column) -> Column:
        n = F.size(h)
        run = lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)])
        place = lambda i: F.least(i, F.lit(_PLACE)).cast("long")
        long_enough = F.transform(F.slice(h, F.lit(1), F.greatest(n - (K - 1), F.lit(0))), lambda x, i: _packed(run(x, i), place(i)))
        short = F.array(_packed(F.xxhash64(h), F.lit(0).cast("long")))
        return F.when(n >= K, long_enough).when(n > 0, short).otherwise(F.array().cast("array<long>"))

    return let(hashes, all_of)


def _numbered(kmers: Column) -> Column:
    """Hash of (k-mer, occurrence) with its place, packed and sorted."""
    same = lambda a, b: F.shiftright(a, 24) == F.shiftright(b, 24)

    def number(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, F.greatest(i - 1, F.lit(0)))))
        # Occurrences count up from 0 within each run of equal k-mers.
        counts = let(starts, lambda b: F.flatten(F.transform(
            b, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(b, j + 1), n) - at - 1))))
        hashed = F.zip_with(s, counts, lambda x, c: _packed(F.xxhash64(F.shiftright(x, 24), c), x.bitwiseAND(F.lit(_PLACE))))
        return F.when(n > 0, F.sort_array(hashed)).otherwise(s)

    return let(F.sort_array(kmers), number)


def _slot(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - _SLOT_BITS)


def _entries(numbered: Column) -> Column:
    """One int per slot in use: its number and 16 bits of the hash of its tuple."""
    smallest = let(numbered, lambda s: F.filter(
        s, lambda x, i: (i < DEPTH) | (_slot(F.get(s, F.greatest(i - DEPTH, F.lit(0)))) != _slot(x))))

    def tuples(m: Column) -> Column:
        first = F.filter(
            F.transform(m, lambda x, i: F.when((i == 0) | (_slot(F.get(m, F.greatest(i - 1, F.lit(0)))) != _slot(x)), i)),
            lambda i: i.isNotNull())

        def entry(i: Column) -> Column:
            slot = _slot(F.get(m, i))
            own = F.filter(F.slice(m, i + 1, F.lit(DEPTH)), lambda x: _slot(x) == slot)
            in_order = F.sort_array(F.transform(
                own, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 39).bitwiseOR(F.shiftrightunsigned(x, 25))))
            text_order = F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << 39) - 1)))
            return (F.shiftleft(slot, 16) + F.xxhash64(text_order).bitwiseAND(F.lit(0xFFFF))).cast("int")

        return F.transform(first, entry)

    return let(smallest, tuples)


def fingerprint(text: Column) -> Column:
    """Slots in use with the hashes of their tuples, as an array of ints in slot order."""
    return _entries(_numbered(_kmers(F.coalesce(text, F.lit("")))))


def as_text(entries: Column) -> Column:
    """Six hex digits per slot in use: two for the slot, four for its tuple."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots in use on either side whose tuples agree."""
    slots = lambda e: F.transform(e, lambda x: F.shiftright(x, 16))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Each document's place in the ascending order of ids, and its successor's.

    A document is named by (key, hash), its id and the hash of its text; a null id comes first, and texts of one id are ordered by length, then hash.
    Rows that repeat id and text are one document. Returns the rows (key, hash, text, n_chars) and the links (key, hash, doc_id,
    next_key, next_hash, n_chars), where n_chars belongs to (key, hash). The last document is followed by the first.
    """
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")).withColumn("hash", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("n_chars", "hash"))
    names = materialize(own.groupBy("key", "hash", "n_chars").agg(F.max("doc_id").alias("doc_id")).withColumn("copy", place))
    counts = successors(names.groupBy("key").agg(F.max("copy").alias("copies")), "key")
    last = F.col("copy") == F.col("copies")
    following = names.join(counts, "key").select(
        "key", "hash", "doc_id", "n_chars", F.when(last, F.col("next")).otherwise(F.col("key")).alias("next_key"),
        F.when(last, 1).otherwise(F.col("copy") + 1).alias("next_copy"))
    named = names.select(F.col("key").alias("next_key"), F.col("copy").alias("next_copy"), F.col("hash").alias("next_hash"))
    return own.drop("doc_id"), materialize(following.join(named, ["next_key", "next_copy"]).drop("next_copy"))


def edit_tail(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each document with ``edited``: its last ``n_chars / share`` characters replaced by as many first ones of the next.

    Giving and taking use the same columns of the rows by the same key, so the texts are shuffled once; what is given away is cut to what is
    taken. Returns key, hash, doc_id, n_chars, text, edited, next_key, next_hash.
    """
    rows, links = neighbours(docs)
    taken = lambda n: F.floor(n / share).cast("int")
    wanted = links.select(
        F.col("next_key").alias("key"), F.col("next_hash").alias("hash"), F.col("key").alias("to_key"),
        F.col("hash").alias("to_hash"), taken(F.col("n_chars")).alias("wanted"))
    head = F.left("text", F.least("wanted", F.col("n_chars").cast("int")))
    heads = rows.join(wanted, ["key", "hash"]).select(
        F.col("to_key").alias("key"), F.col("to_hash").alias("hash"), head.alias("head")).groupBy("key", "hash").agg(
        F.first("head").alias("head"))
    kept = F.left("text", F.col("n_chars").cast("int") - taken(F.col("n_chars")))
    return rows.join(heads, ["key", "hash"]).join(links.drop("n_chars"), ["key", "hash"]).withColumn(
        "edited", F.concat(kept, F.col("head"))).drop("head")


def compare_with_edits(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of all texts and of their edits, and how alike they are to each other and to the next document's.

    Returns doc_id, n_chars, edited_sha256, entries, edited_entries, near_edited, near_next.
    """
    marked = materialize(edit_tail(docs, share).select(
        "key", "hash", "doc_id", "n_chars", "next_key", "next_hash", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("entries"), fingerprint(F.col("edited")).alias("edited_entries")))
    following = marked.select(
        F.col("key").alias("next_key"), F.col("hash").alias("next_hash"), F.col("entries").alias("next_entries")).groupBy(
        "next_key", "next_hash").agg(F.first("next_entries").alias("next_entries"))
    return marked.join(following, ["next_key", "next_hash"]).select(
        "doc_id", "n_chars", "edited_sha256", "entries", "edited_entries",
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))
