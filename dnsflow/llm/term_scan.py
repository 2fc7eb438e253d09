"""Ranked lexical search without an index: an automaton of all item terms reads the documents.

Terms are maximal runs of digits, letters of ASCII and everything beyond ASCII, only A-Z lower-cased. Each term stands in an Aho-Corasick
automaton between two spaces, and a text is read with every separator as a space, so the automaton finds whole terms only, overlapping
spaces included. One scan of the texts gives each document's number of terms and the occurrences of item terms in it; the corpus totals
and document frequencies follow from that, and scores are added up over the lists of items that hold a term. A task keeps the best of each
item among its documents only, so what is shuffled is at most top x items rows a task.

Items are taken in blocks of at most ``ITEM_BYTES`` of text (a longer item alone), by ascending id: one automaton, one broadcast and one scan each.

Scores: weight floor(1000 ln((2N+2)/(2df+1))) of a term, times (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L; 64-bit integers
but for the logarithm. N counts documents with a term, L all their terms, n those of one document.

Null and empty texts have no terms: such a document is never found and not counted in N, such an item finds nothing. Rows that share an id
are documents (items) of their own, each with its rank; ids are read as long; equal scores are ranked by ascending doc_id, null last. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.operators.scale import materialize, running_totals, union_all

ITEM_BYTES = 8 << 20    # of item texts in one automaton
CELLS = 1 << 20         # scores that a task holds at a time
SALTS = 16              # of an item's candidates, before they meet
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def read(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z in lower case and every separator a space."""
    return (text or "").encode().translate(_BYTES)


def automaton(terms: list[bytes]):
    """Finds the place of each term in ``terms``, between two spaces."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", place)
    if terms:
        found.make_automaton()
    return found


def scan(docs: DataFrame, terms: list[bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n (terms of the document), term (places of the item terms in it, ascending), tf; written once, for all that follows."""
    schema = "key long, n long, term array<int>, tf array<long>"

    def run(batches):
        found = automaton(terms)
        for batch in batches:
            counts, held = [], []
            for value in batch.column("text"):
                raw = read(value.as_py())
                counts.append(len(raw.split()))
                held.append(sorted(Counter(place for _, place in found.iter(f" {raw.decode('latin-1')} ")).items()) if terms else [])
            flat = [pair for own in held for pair in own]
            ends = pa.array(np.cumsum([0, *map(len, held)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array([p for p, _ in flat], pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array([n for _, n in flat], pa.int64()))], ["key", "n", "term", "tf"])

    return materialize(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema))


def weights(scanned: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term: as many numbers on the driver as there are item terms."""
    documents, total = scanned.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(terms, np.int64)
    for term, n in scanned.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():
        df[term] = n
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()]
    return documents, total, np.array(weight, np.int64)


def _scores(batch: pa.RecordBatch, weight: np.ndarray, lists: list[np.ndarray], items: int, documents: int, total: int) -> np.ndarray:
    """Scores of all items (columns) for the documents of the batch (rows)."""
    held = batch.column("term").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    term, tf = batch.column("term").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
    n = batch.column("n").to_numpy()
    m = 50 + (50 * n * documents) // max(total, 1)
    points = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, held)))
    scores = np.zeros(batch.num_rows * items, np.int64)
    sizes, flat = lists
    spread = sizes[term]
    starts = (np.cumsum(sizes) - sizes)[term]
    at = np.arange(spread.sum()) + np.repeat(starts - (np.cumsum(spread) - spread), spread)
    row = np.repeat(np.repeat(np.arange(batch.num_rows), held), spread)
    np.add.at(scores, row * items + flat[at], np.repeat(points, spread))
    return scores.reshape(batch.num_rows, items)


def _best(kept: list[tuple[np.ndarray, ...]], top: int) -> tuple[np.ndarray, ...]:
    """Of rows (item, score, whether the key is null, key), the ``top`` first of each item."""
    item, score, missing, key = (np.concatenate(column) for column in zip(*kept))
    order = np.lexsort((key, missing, -score, item))
    item = item[order]
    first = np.arange(len(item)) - np.searchsorted(item, item, "left") < top
    return item[first], *(column[order][first] for column in (score, missing, key))


def candidates(scanned: DataFrame, weight: np.ndarray, items: list[list[int]], documents: int, total: int, top: int) -> DataFrame:
    """item (place in ``items``, lists of places of terms), key, score: of each task the ``top`` best of each item."""
    pairs = np.array(sorted((t, i) for i, own in enumerate(items) for t in own), np.int64).reshape(-1, 2)
    lists = [np.bincount(pairs[:, 0], minlength=len(weight)).astype(np.int64), pairs[:, 1]]
    rows = max(1, CELLS // max(1, len(items)))

    def run(batches):
        kept, held = [], 0
        least = np.zeros(len(items), np.int64)      # a document below can't be among the best; one that equals it may be
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                scores = _scores(batch, weight, lists, len(items), documents, total)
                row, item = np.nonzero((scores > 0) & (scores >= least))
                missing = batch.column("key").is_null().to_numpy(zero_copy_only=False)
                kept.append((item, scores[row, item], missing[row], batch.column("key").fill_null(0).to_numpy()[row]))
                held += len(row)
                if held > 4 * top * len(items):
                    kept = [_best(kept, top)]
                    held = len(kept[0][0])
                    full = np.bincount(kept[0][0], minlength=len(items)) == top
                    last = np.searchsorted(kept[0][0], np.arange(len(items)), "right") - 1
                    least = np.where(full, kept[0][1][np.maximum(last, 0)], 0)
        if held:
            item, score, missing, key = _best(kept, top)
            rows_out = pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(key, mask=missing), pa.array(score)], ["item", "key", "score"])
            yield from (rows_out.slice(at, 10_000) for at in range(0, len(item), 10_000))

    return scanned.where("size(term) > 0").mapInArrow(run, "item long, key long, score long")


def _block(items: list[tuple], docs: DataFrame, top: int, text: str, key: str) -> DataFrame:
    own = [sorted(set(read(t).split())) for _, t in items]
    terms = sorted({t for held in own for t in held})
    place = {t: i for i, t in enumerate(terms)}
    scanned = scan(docs, terms, text, key)
    documents, total, weight = weights(scanned, len(terms))
    found = candidates(scanned, weight, [[place[t] for t in held] for held in own], documents, total, top)
    order = [F.desc("score"), F.asc_nulls_last("key")]
    salted = found.withColumn("_salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    ids = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", F.col("key").alias(key), "score")


def search(items: DataFrame, docs: DataFrame, top: int = 50, text: str = "text", key: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, the highest first."""
    own = materialize(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"),
                                   F.monotonically_increasing_id().alias("row")))
    sized = own.select("item_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    blocks = materialize(running_totals(sized, ["item_id", "row"], {"upto": "bytes"}).select(
        "row", F.expr(f"(upto - bytes) div {ITEM_BYTES}").alias("block")))
    numbers = [b for b, in blocks.select("block").distinct().orderBy("block").collect()]
    block = lambda b: own.join(blocks.where(F.col("block") == b), "row").orderBy("item_id", "row").select("item_id", "text")
    parts = [_block([tuple(r) for r in block(b).collect()], docs, top, text, key) for b in numbers]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id long, rank int, `{key}` long, score long")
    return union_all(parts)
