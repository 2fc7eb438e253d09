"""Which tokens of two tokenizers stand for the same bytes: groups, links and corpus-wide counts of linked id pairs.

A text, with a space before it, is encoded by A (a byte-level BPE of the tokenizers library) and by B (a sentencepiece model, which adds
that space itself). Byte offsets where a token of A and one of B both end cut the tokens into groups, and every token of A is linked with
every token of B in its group. Most groups hold one token of each side with the same bytes. For these an array maps each A id to the B id of
the same bytes (``identity``), so that they are counted by A id alone in vectors as long as the vocabulary. Only the other pairs, from
irregular groups, are shuffled as pairs.

Neither tokenizer has a token that reaches across a space after a visible character, so a text is the sequence of its chunks between such
places, and groups end there too. Chunks repeat: each different one of a batch of texts is encoded and aligned once. Where a model has such
tokens, or a pre-tokenizer other than the plain byte-level one, whole texts are aligned.

Null and empty texts have no tokens: zeros, and '' as digest. So have texts whose tokens of either side don't join to the text's own bytes
(a text that holds U+2581, say). Repeated rows are documents of their own. Extra columns are not looked at; results carry ``key`` only, null or not.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.operators.scale import lookup_join, materialize

ROWS, BYTES = 2048, 1 << 20     # texts that are cut into chunks at a time; a longer text comes alone
JOINED = 200                    # chunks that are encoded in one call
LARGE_GROUP = 1 << 16           # links of a group from which its ids are counted before they are paired
#: Visible characters; a cut needs one before the space, and something after the space. Others only make chunks longer.
VISIBLE = r"!-~¡-ɏͰ-ԯؠ-ۓぁ-ヿ一-鿿가-힣"
_CUT = re.compile(f"(?<=[{VISIBLE}])(?= .)", re.DOTALL)
_INNER_SPACE = re.compile("[^▁]▁")


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    moved = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(moved)}


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True     # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = a_token_bytes(self.a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.b_size = len(pieces)
        self.identity = identity_map(self.a_bytes, self.b_bytes, [bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p in pieces])
        self.cuts = not any(_INNER_SPACE.search(p) for p in pieces) and _plain_byte_level(self.a)
        self.a_raw, self.b_raw = pa.array(self.a_bytes, pa.binary()), pa.array(self.b_bytes, pa.binary())
        self.lengths = [np.array(list(map(len, raws)), np.int64) for raws in (self.a_bytes, self.b_bytes)]
        self.names = pa.array([str(i) for i in range(max(len(self.a_bytes), self.b_size))])

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self.identity[a] == b, -1 - a, a * self.b_size + b)

    def encoded(self, chunks: list[str], joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order of the chunks, their bytes in that order, and the ids of A and B one chunk after the other.

        Chunks that end with a visible character (``joins``) are encoded many in a call. A chunk whose tokens don't join to its bytes gets 0 bytes.
        """
        joined = np.flatnonzero(joins)
        blocks = [joined[at:at + JOINED] for at in range(0, len(joined), JOINED)] + [np.array([i]) for i in np.flatnonzero(~joins)]
        parts = list(zip(blocks, *self._encode([" ".join([chunks[i] for i in b.tolist()]) for b in blocks])))
        torn = [i for block, _, _, whole in parts if not whole for i in block.tolist()]
        if torn:
            parts = [p for p in parts if p[3]] + [([i], *p) for i, p in zip(torn, zip(*self._encode([chunks[i] for i in torn])))]
        none, sizes = np.zeros(0, np.int32), np.fromiter((len(c.encode()) + 1 for c in chunks), np.int64, len(chunks))
        for block, _, _, whole in parts:
            if not whole:
                sizes[block] = 0
        order = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
        a, b = (np.concatenate([none, *[p[side] for p in parts if p[3]]]).astype(np.int64) for side in (1, 2))
        return order, sizes[order], a, b

    def _encode(self, strings: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B of each string, and whether both join to its bytes."""
        spaced = [f" {s}" for s in strings]
        a = [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = [np.array(ids, np.int32) for ids in self.b.encode(strings, num_threads=1)] if strings else []
        raws = [s.encode() for s in spaced]
        return a, b, np.array([x == y == r for x, y, r in zip(_joined(a, self.a_raw), _joined(b, self.b_raw), raws)], bool)


def _joined(ids: list[np.ndarray], raw: pa.BinaryArray) -> list[bytes]:
    """The bytes of the tokens of each list."""
    tokens = raw.take(pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    places = np.frombuffer(tokens.buffers()[1], np.int32)[_starts(np.fromiter(map(len, ids), np.int64, len(ids)))].tolist()
    data = tokens.buffers()[2].to_pybytes() if places[-1] else b""
    return [data[x:y] for x, y in zip(places, places[1:])]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, the runs as long as ``counts``."""
    return np.diff(_starts(values)[_starts(counts)])


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each run, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_starts(counts).astype(np.int32)), values)


@dataclass(frozen=True)
class Chunks:
    """Aligned chunks, the i-th of those given at ``place[i]``: of each the numbers of tokens, groups and links and the groups as text; its
    link codes lie from ``first`` on, ``held`` of them.

    A code is -1 - A id for a link with the identity of that id, else A id * size of B + B id; ``times`` says how often.
    """

    place: np.ndarray
    whole: np.ndarray
    totals: np.ndarray
    groups: pa.StringArray
    codes: np.ndarray
    times: np.ndarray
    first: np.ndarray
    held: np.ndarray


def align_chunks(aligner: Aligner, chunks: list[str], joins: np.ndarray) -> Chunks:
    """Align chunks, all different and without the space that begins them."""
    order, sizes, a, b = aligner.encoded(chunks, joins)
    ends, end_a, end_b = np.cumsum(sizes), np.cumsum(aligner.lengths[0][a]), np.cumsum(aligner.lengths[1][b])
    n_a, n_b = (np.diff(np.searchsorted(e, ends, "right"), prepend=0) for e in (end_a, end_b))
    common_a, common_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    groups = int(common_a.sum())
    left = np.bincount(np.cumsum(common_a) - common_a, minlength=groups).astype(np.int64)
    right = np.bincount(np.cumsum(common_b) - common_b, minlength=groups).astype(np.int64)
    from_a, from_b = np.cumsum(left) - left, np.cumsum(right) - right
    n_groups = _sums(common_a.astype(np.int64), n_a)
    chunk_of = np.repeat(np.arange(len(chunks)), n_groups)
    regular = (left == 1) & (right == 1)
    regular[regular] = aligner.identity[a[from_a[regular]]] == b[from_b[regular]]
    parts = [(chunk_of[regular], -1 - a[from_a[regular]], np.ones(int(regular.sum()), np.int64))]
    products = left * right
    large = np.flatnonzero(products > LARGE_GROUP)
    some = np.flatnonzero(~regular & (products <= LARGE_GROUP))
    group = np.repeat(some, products[some])
    place = _spread(np.zeros(len(some), np.int64), products[some])
    pair_a, pair_b = a[from_a[group] + place // right[group]], b[from_b[group] + place % right[group]]
    parts.append((chunk_of[group], aligner.code(pair_a, pair_b), np.ones(len(group), np.int64)))
    for g in large.tolist():    # different ids of each side first, so that the work doesn't grow with the product
        ids_a, times_a = np.unique(a[from_a[g]:from_a[g] + left[g]], return_counts=True)
        ids_b, times_b = np.unique(b[from_b[g]:from_b[g] + right[g]], return_counts=True)
        codes = aligner.code(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)))
        parts.append((np.full(len(codes), chunk_of[g]), codes, np.repeat(times_a, len(ids_b)) * np.tile(times_b, len(ids_a))))
    chunk, codes, times = (np.concatenate(p) for p in zip(*parts))
    by_chunk = np.argsort(chunk, kind="stable")
    held = np.bincount(chunk, minlength=len(chunks)).astype(np.int64)
    join = lambda values, counts, by: pc.binary_join(_lists(values, counts), by)
    written = pc.binary_join_element_wise(
        join(aligner.names.take(pa.array(a)), left, ","), join(aligner.names.take(pa.array(b)), right, ","), "|")
    place = np.empty(len(chunks), np.int64)
    place[order] = np.arange(len(chunks))
    return Chunks(place, sizes > 0, np.stack([n_a, n_b, n_groups, _sums(products, n_groups)]), join(written, n_groups, ";"),
                  codes[by_chunk], times[by_chunk], np.cumsum(held) - held, held)


def a_token_bytes(tokenizer) -> list[bytes]:
    alphabet = byte_level_alphabet()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [added[i] if i in added else bytes(alphabet[c] for c in vocabulary.get(i, ""))
            for i in range(max(vocabulary) + 1)]


def piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], single: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 if there is none; a written piece goes before a single byte, then the smaller id."""
    b_of = {}
    for i in sorted(range(len(b_bytes)), key=lambda i: (single[i], i)):
        b_of.setdefault(b_bytes[i], i)
    return np.array([b_of.get(raw, -1) for raw in a_bytes], np.int64)


def _plain_byte_level(tokenizer) -> bool:
    """Whether A cuts a text by the usual byte-level pattern only, no match of which goes on with a space after a visible character."""
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    return made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True \
        and not before.get("add_prefix_space")


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _sequences(aligner: Aligner, texts: pa.StringArray) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Different chunks without the space that begins them, whether each ends with a visible character, and for each text the places of its
    own chunks, in order; none for an empty text."""
    if not aligner.cuts:
        lengths = pc.utf8_length(texts).to_pylist()
        return texts.to_pylist(), np.zeros(len(texts), bool), [np.arange(i, i + 1)[:n] for i, n in enumerate(lengths)]
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int64)
    chunks = coded.dictionary.to_pylist()
    # A space cuts only after a visible character; texts in which another space stands, or that end with one, are cut by the pattern.
    visible = np.array(pc.match_substring_regex(coded.dictionary, f"[{VISIBLE}]\\z"), bool)
    ends = _starts(words.value_lengths().to_numpy()).tolist()
    sequences, place_of = [], {}
    for i, (start, end) in enumerate(zip(ends, ends[1:])):
        own = places[start:end]
        if not visible[own[:-1]].all() or len(own) > 1 and not chunks[own[-1]]:
            place_of = place_of or {c: j for j, c in enumerate(chunks)}
            parts = [p[1:] for p in _CUT.split(f" {texts[i]}")]
            for part in parts:
                if place_of.setdefault(part, len(chunks)) == len(chunks):
                    chunks.append(part)
            own = np.array([place_of[p] for p in parts], np.int64)
        elif len(own) == 1 and not chunks[own[0]]:
            own = own[:0]
        sequences.append(own)
    return chunks, np.concatenate([visible, np.zeros(len(chunks) - len(visible), bool)]), sequences


def _documents(aligner: Aligner, texts: pa.StringArray) -> list[pa.Array]:
    """Columns n_a, n_b, n_groups, n_links, groups_sha256, same, same_times, pairs, pair_times of the texts."""
    chunks, visible, sequences = _sequences(aligner, texts.fill_null(""))
    aligned = align_chunks(aligner, chunks, visible)
    sequences = [aligned.place[s] for s in sequences]
    sequences = [s if aligned.whole[s].all() else s[:0] for s in sequences]
    n, lengths = len(sequences), np.fromiter(map(len, sequences), np.int64, len(sequences))
    at = np.concatenate([np.zeros(0, np.int64), *sequences])
    totals = [_sums(t[at], lengths) for t in aligned.totals]
    written = pc.binary_join(_lists(aligned.groups.take(pa.array(at)), lengths), ";").cast(pa.binary())
    digests = [hashlib.sha256(w.as_py()).hexdigest() if m else "" for w, m in zip(written, lengths.tolist())]
    # Each different chunk of a text once, then each different code.
    held, often = np.unique(np.repeat(np.arange(n), lengths) * len(chunks) + at, return_counts=True)
    doc, chunk = (held // len(chunks), held % len(chunks)) if chunks else (held, held)
    take = _spread(aligned.first[chunk], aligned.held[chunk])
    keys = (np.repeat(doc, aligned.held[chunk]) << 40) + aligned.codes[take] + (1 << 39)
    times = aligned.times[take] * np.repeat(often, aligned.held[chunk])
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
    doc, code = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 39)
    same = code < 0
    columns = [pa.array(t, pa.int64()) for t in totals] + [pa.array(digests, pa.string())]
    for chosen, values, kind in ((same, -1 - code, pa.int32()), (~same, code, pa.int64())):
        counts = np.bincount(doc[chosen], minlength=n)
        columns += [_lists(pa.array(values[chosen], kind), counts), _lists(pa.array(times[chosen], pa.int64()), counts)]
    return columns


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, at most ROWS with at most BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    upto, start = _starts(sizes.astype(np.int64)), 0
    while start < batch.num_rows:
        stop = max(start + 1, min(start + ROWS, int(np.searchsorted(upto, upto[start] + BYTES, "right")) - 1))
        yield batch.slice(start, stop - start)
        start = stop


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: row, key, n_a, n_b, n_groups, n_links, groups_sha256, same, same_times, pairs, pair_times.

    ``same`` holds the different A ids linked with their identity, ``pairs`` the other linked pairs as A id * size of B + B id; both with how
    often. The result is written, so that ``row`` stays what it is.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    ids, times, long = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.LongType(), False), T.LongType()
    fields = {"n_a": long, "n_b": long, "n_groups": long, "n_links": long, "groups_sha256": T.StringType(), "same": ids, "same_times": times,
              "pairs": times, "pair_times": times}
    schema = T.StructType([*own.schema.fields[:2], *[T.StructField(n, kind) for n, kind in fields.items()]])

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for whole in batches:
            for batch in _parts(whole):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("key"), *_documents(aligner, batch.column("text"))], schema.names)
                pa.default_memory_pool().release_unused()

    return materialize(own.mapInArrow(run, schema))


def identity_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """For each A id the number of documents that hold it linked with its identity: a vector as long as the vocabulary."""
    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("same").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["a", "n"])

    vector = np.zeros(size, np.int64)
    for a, n in aligned.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        vector[a] = n
    return vector


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: the number of documents that hold each linked pair off the identity map."""
    return materialize(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))


def document_sums(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Add ``n_best``, the links whose count is the highest of their A id, and ``count_sum``, the counts of all links.

    What the driver holds is as long as A's vocabulary; the pair counts are broadcast behind a check of their size, else joined by a shuffle.
    """
    aligner = _aligner(a_path, b_path)
    size, width = len(aligner.a_bytes), aligner.b_size
    vector, counted = identity_counts(aligned, size), pair_counts(aligned)
    best = vector.copy()
    for a, n in counted.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n")).collect():
        best[a] = max(best[a], n)
    top = vector == best

    def on_map(batches):
        for batch in batches:
            ids, times = batch.column("same").flatten().to_numpy(), batch.column("same_times").flatten().to_numpy()
            held = batch.column("same").value_lengths().to_numpy()
            sums = [pa.array(_sums(times * weight[ids], held), pa.int64()) for weight in (top, vector)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *sums], ["row", "n_best", "count_sum"])

    regular = aligned.select("row", "same", "same_times").mapInArrow(on_map, "row long, n_best long, count_sum long")
    spark = aligned.sparkSession
    highest = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, best long")
    known = counted.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(highest), "a").select(
        "pair", "n", (F.col("n") == F.col("best")).alias("top"))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("l")).select(
        "row", F.col("l.pairs").alias("pair"), F.col("l.pair_times").alias("times"))
    irregular = lookup_join(links, materialize(known), ["pair"], "inner", ["row"]).groupBy("row").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = regular.unionByName(irregular).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("same", "same_times", "pairs", "pair_times").join(sums, "row").drop("row")


def correspondence(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, documents: every linked pair of ids and the number of documents that hold it."""
    aligner = _aligner(a_path, b_path)
    vector = identity_counts(aligned, len(aligner.a_bytes))
    rows = [(int(a), int(aligner.identity[a]), int(vector[a])) for a in np.flatnonzero(vector)]
    regular = aligned.sparkSession.createDataFrame(rows, "a long, b long, documents long")
    return regular.unionByName(pair_counts(aligned).select(
        F.expr(f"pair div {aligner.b_size}").alias("a"), F.expr(f"pair % {aligner.b_size}").alias("b"), F.col("n").alias("documents")))
