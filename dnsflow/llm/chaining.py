"""Substring deduplication by collinear chaining.

Seeds are the minimizers of five-word runs: any equal stretch of ``WINDOW + SEED - 1`` words holds one in both texts. Equal seeds
of a text are numbered, so texts that repeat themselves still link in order. Each occurrence of a seed is linked to its first one, by doc_id, and to the one
before it, so a passage that n documents share costs 2 n links and not n^2. Later occurrences in a text are also linked to the first one of the earliest
document that has the seed, whatever their number, so each further copy of a passage is found. Where seeds are frequent, their first and previous documents
are others than those of the passage; so runs of ``RUN`` consecutive minimizers, all of which occur in three documents or more, are seeds too, linked in the
same way by both their ends: any equal stretch of 44 words holds a run or a rarer seed. The links of two documents are merged into fragments along a diagonal; fragments are chained in order by
a Fenwick tree of best scores, where words between fragments cost ``GAP`` on either side. Chains are then aligned word by word: fragments are
extended, gaps are aligned, and fragments are joined into a passage as long as ``ALIKE`` of its words agree.

A repeated span is the union of passages that touch in a document; only spans of ``LEAST_WORDS`` words and more count, so a passage that is
found in pieces, with different documents, is found whole. Spans are always the later occurrence: the earliest document keeps its text.

Rows of one seed are sorted in one task: at most one row per occurrence, while a text sends a row for every sixth word or so to all tasks, so even a passage in a
third of all documents weighs about as much as an even share.

Gaps with a side above ``LARGEST_GAP`` words are taken as all different, so a passage with a longer insertion is found as two; pieces under
``LEAST_PIECE`` words count towards no span.

Nulls: a null text is empty; texts under five words have no seeds. A null doc_id takes part (its key is a hash of the text), and is null in results.
A document is a doc_id and a text: rows that share both are one, and a passage that repeats only among them, or within one text, does not count.
Rows that share the doc_id and not the text are documents of their own; their keys are hashes of both. Extra columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.llm.common import WORD, unused
from dnsflow.llm.jaccard_join import mix, shingle_hashes, word_hashes
from dnsflow.operators.scale import lookup_join, materialize, release

SEED, WINDOW = 5, 10
RUN = 4                     # consecutive minimizers that make a rarer seed
GAP = 0.2                   # cost of a word between two fragments, on either side; a chained word earns 1
ALIKE = 0.8
LEAST_PIECE, LEAST_WORDS = 25, 50
MARGIN = 40                 # words beyond a chain that its ends may grow into
LARGEST_GAP = 200           # gaps with a longer side are not aligned word by word


def minimizers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each run of ``window`` hashes, ascending."""
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    # The smallest of ever wider runs and its place, the first of equal ones.
    least, at, width = hashes, np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        at = np.where(least[step:] < least[:-step], at[step:], at[:-step])
        least, width = np.minimum(least[step:], least[:-step]), width + step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first occurrence of a value from the second, and so on."""
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return hashes
    order = np.argsort(hashes, kind="stable")
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    at = np.arange(len(ordered))
    count = at - np.maximum.accumulate(np.where(starts, at, 0))
    out = np.empty_like(hashes)
    out[order] = np.where(count > 0, mix(ordered + count.astype(np.uint64)), ordered)
    return out


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The ids that several texts share: doc_id, several. Written once; mostly empty."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    return materialize(texts.groupBy("doc_id").agg((F.min("t") != F.max("t")).alias("several")).where("several"))


def keyed(docs: DataFrame, several: DataFrame, key: str = "key") -> DataFrame:
    """Add ``key`` to the documents: the doc_id, or a hash where it is null or names several texts (``several`` of ``repeated_ids``)."""
    told, = unused([*docs.columns, key], "_several")
    ids = several.withColumnRenamed("several", told)
    marked = lookup_join(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ids, ["doc_id"], "left", spread=["text"])
    own = F.when(F.col(told), F.xxhash64("doc_id", F.xxhash64("text"))).otherwise(F.coalesce("doc_id", F.xxhash64("text")))
    return marked.withColumn(key, own).drop(told)


def _keyed(docs: DataFrame, several: DataFrame) -> DataFrame:
    """Each document once: key, text."""
    return keyed(docs.select("doc_id", "text"), several).select("key", "text")


#: How a row stands for its seed: the text's first occurrence, a later one under a seed that also tells its number, and that one under the plain seed.
FIRST, LATER, AGAIN = 0, 1, 2


def _told(places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and places (with the kind in the two lowest bits) of the occurrences of hashes in one text."""
    told = numbered(hashes)
    later = told != hashes
    return np.concatenate([told, hashes[later]]).view(np.int64), np.concatenate([places << 2 | later * LATER, places[later] << 2 | AGAIN])


def _runs_of_words(keys: list[int], texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of the ``SEED``-word runs of each text that has one. Short texts are hashed together: per text, numpy's calls cost more than the work."""
    held, size = [], 0

    def out():
        if held:
            hashes, start = shingle_hashes(np.concatenate([w for _, w in held]), SEED), 0
            for key, words in held:
                yield key, hashes[start:start + len(words) - SEED + 1]
                start += len(words)

    for key, text in zip(keys, texts):
        words = word_hashes(text.as_py())
        if len(words) >= SEED:
            held.append((key, words))
            size += len(words)
        if size >= 16_384:
            yield from out()
            held, size = [], 0
    yield from out()


def seeds(texts: DataFrame) -> DataFrame:
    """key, seed, place of every minimizer of every text. A place holds the word, the number of the minimizer in its text and the kind."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys, found, places = [], [], []
                for key, hashes in _runs_of_words(part.column("key").to_pylist(), part.column("text")):
                    at = minimizers(hashes)
                    own = _told(at << 30 | np.arange(len(at)), hashes[at])
                    found.append(own[0])
                    places.append(own[1])
                    keys.append(np.full(len(own[0]), key, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, found, places)], ["key", "seed", "place"])

    return texts.mapInArrow(run, "key long, seed long, place long")


def shared(found: DataFrame) -> DataFrame:
    """Occurrences of seeds that occur more than once, with ``docs``, in how many documents, and their partners: the first occurrence and, but for
    ``AGAIN``, the one before."""
    whole = Window.partitionBy("seed")
    order = whole.orderBy("key", "place")
    upto = lambda row: order.rowsBetween(Window.unboundedPreceding, row)
    own, again = F.struct("key", "place"), F.col("place").bitwiseAND(3) == AGAIN
    before = F.when(~again, F.last(F.when(~again, own), ignorenulls=True).over(upto(-1)))
    return found.select(
        "key", "seed", "place", F.count(F.lit(1)).over(whole).alias("rows"), F.count(F.when(~again, 1)).over(whole).alias("docs"),
        F.first(own).over(upto(Window.currentRow)).alias("first"), before.alias("before")).where("rows > 1").drop("rows")


def anchors(rows: DataFrame, runs: bool = False) -> DataFrame:
    """Links of occurrences of ``shared`` to their partners in other documents: key, other, pos, other_pos; of ``runs`` both ends."""
    linked = rows.where("key != first.key")
    both = F.when(
        (F.col("before.key") != F.col("key")) & (F.col("before.key") != F.col("first.key")), F.array("first", "before")
    ).otherwise(F.array("first"))
    word = lambda place: F.shiftright(place, 32).cast("int")
    reach = lambda place: F.shiftright(place, 2).bitwiseAND((1 << 30) - 1).cast("int")
    ends = lambda a, b: F.array(*[F.struct((word(a) + x).alias("pos"), (word(b) + y).alias("other_pos"))
                                  for x, y in [(F.lit(0), F.lit(0)), (reach(a), reach(b))][:2 if runs else 1]])
    return linked.select("key", "place", F.explode(both).alias("o")).select(
        "key", F.col("o.key").alias("other"), F.explode(ends(F.col("place"), F.col("o.place"))).alias("e")).select("key", "other", "e.*")


def run_seeds(rows: DataFrame) -> DataFrame:
    """Seeds of runs of ``RUN`` consecutive minimizers that all occur in more than two documents; a place holds the run's first word and its reach.

    A seed of two documents links them as it is; where all are more frequent, their partners may be other documents than those of the passage.
    """
    often = rows.where((F.col("docs") > 2) & (F.col("place").bitwiseAND(3) != LATER)).select("key", "seed", "place")

    def of_text(seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, fresh = np.unique(place >> 2, return_index=True)
        seed, number, word = seed[fresh], place & ((1 << 30) - 1), place >> 30
        if len(seed) < RUN:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        together = number[RUN - 1:] - number[:1 - RUN] == RUN - 1
        hashes, first, last = shingle_hashes(seed.view(np.uint64), RUN)[together], word[:1 - RUN][together], word[RUN - 1:][together]
        return _told(first << 30 | last - first, hashes)

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "seed", "place")]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(now[0])) + 1])
            held = [c[edges[-1]:].copy() for c in now]      # the last text may go on in the next batch
            yield from out(now, edges)
        if held is not None and len(held[0]):
            yield from out(held, np.array([0, len(held[0])]))

    def out(columns, edges):
        found = [(columns[0][a], *of_text(columns[1][a:b], columns[2][a:b])) for a, b in zip(edges.tolist(), edges[1:].tolist())]
        if found:
            keys = np.concatenate([np.full(len(s), k, np.int64) for k, s, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2)]],
                                             ["key", "seed", "place"])

    return often.repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, "key long, seed long, place long")


def links(texts: DataFrame) -> DataFrame:
    """All links between documents, written once; what led to them is deleted."""
    single = materialize(shared(seeds(texts)))
    release(single.sparkSession)
    runs = materialize(shared(run_seeds(single)))
    found = materialize(anchors(single).unionByName(anchors(runs, runs=True)))
    release(found.sparkSession, single, runs)
    return found


class BestUpTo:
    """Fenwick tree over ranks: the best (score, item) at a rank or below."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def add(self, rank: int, entry: tuple[float, int]) -> None:
        i = rank + 1
        while i < len(self.best):
            if entry > self.best[i]:
                self.best[i] = entry
            i += i & -i

    def up_to(self, rank: int) -> tuple[float, int]:
        i, found = rank + 1, (float("-inf"), -1)
        while i:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def chain(fragments: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of fragments (x, y, words), best first; each fragment is in one chain.

    A chain's score is its words less ``GAP`` times the words between its fragments, in both texts.
    """
    order = sorted(fragments)
    n = len(order)
    if n == 2:      # as below, without the tree
        (x, y, words), (x1, y1, words1) = order
        end, end_y = x + words - SEED + 1, y + words - SEED + 1
        gain = words + GAP * (end + end_y) - GAP * (x1 + y1) if end <= x1 and end_y <= y1 else 0.0
        if gain > 0 and words1 + gain > words:
            return [order]
        return [[order[0]], [order[1]]] if words >= words1 + max(gain, 0.0) else [[order[1]], [order[0]]]
    # Two fragments on different diagonals may overlap by less than a seed.
    ends = [(x + w - SEED + 1, y + w - SEED + 1) for x, y, w in order]
    ranks = {y: r for r, y in enumerate(sorted({e[1] for e in ends} | {f[1] for f in order}))}
    tree, waiting, score, parent = BestUpTo(len(ranks)), sorted(range(n), key=lambda i: ends[i][0]), [0.0] * n, [-1] * n
    done = 0
    for i, (x, y, words) in enumerate(order):
        while done < n and ends[waiting[done]][0] <= x:
            j = waiting[done]
            tree.add(ranks[ends[j][1]], (score[j] + GAP * sum(ends[j]), j))
            done += 1
        best, j = tree.up_to(ranks[y])
        gain = best - GAP * (x + y)
        score[i], parent[i] = (words + gain, j) if gain > 0 else (float(words), -1)
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        members = []
        while i >= 0 and not used[i]:
            used[i] = True
            members.append(order[i])
            i = parent[i]
        if members:
            chains.append(members[::-1])
    return chains


def _fragments(x: np.ndarray, y: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Starts of the fragments in anchors sorted by group and x."""
    step = np.diff(x)
    new = (np.diff(group) != 0) | (np.diff(x - y) != 0) | (step > WINDOW + SEED)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _chains_of(key, other, x, y) -> Iterator[tuple]:
    """Chains (key, other, xs, ys, words) with two anchors or more, of anchors sorted by (key, other, x, y)."""
    fresh = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(other) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)])
    key, other, x, y = key[fresh], other[fresh], x[fresh], y[fresh]
    group = np.cumsum(np.concatenate([[0], ((np.diff(key) != 0) | (np.diff(other) != 0)).astype(np.int64)]))
    starts = _fragments(x, y, group)
    last = np.concatenate([starts[1:], [len(x)]]) - 1
    counts = last - starts + 1
    words = x[last] - x[starts] + SEED
    owner = group[starts]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(starts)]])
    anchors_in = np.add.reduceat(counts, edges[:-1])
    for a, b, n in zip(edges[:-1].tolist(), edges[1:].tolist(), anchors_in.tolist()):
        if n < 2:
            continue
        k, o = int(key[starts[a]]), int(other[starts[a]])
        own = list(zip(x[starts[a:b]].tolist(), y[starts[a:b]].tolist(), words[a:b].tolist()))
        for members in (chain(own) if b - a > 1 else [own]):
            if len(members) > 1 or members[0][2] > SEED:
                yield (k, o, *map(list, zip(*members)))


_CHAIN = "key long, other long, xs array<int>, ys array<int>, words array<int>"


def chains(links: DataFrame) -> DataFrame:
    """Chains of the links of each pair of documents."""
    names = ["key", "other", "xs", "ys", "words"]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]

    def out(rows):
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("key", "other", "pos", "other_pos")]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now)]
            if not len(now[0]):
                continue
            breaks = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0))
            cut = int(breaks[-1]) + 1 if len(breaks) else 0     # the last pair may go on in the next batch
            held = [c[cut:].copy() for c in now]
            if cut:
                yield out(list(_chains_of(*[c[:cut] for c in now])))
        if held is not None and len(held[0]):
            yield out(list(_chains_of(*held)))

    placed = links.repartition("key", "other").sortWithinPartitions("key", "other", "pos", "other_pos")
    return placed.mapInArrow(run, _CHAIN)


def _gap_matches(a: Sequence[int], b: Sequence[int]) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b) or max(len(a), len(b)) > LARGEST_GAP:
        return 0
    places: dict[int, int] = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    # A bit is cleared where the length grows from one prefix of b to the next (Hyyrö, 2004).
    every = open_ = (1 << len(b)) - 1
    for word in a:
        same = open_ & places.get(word, 0)
        open_ = (open_ + same | open_ - same) & every
    return len(b) - open_.bit_count()


def _grown(a: list[int], b: list[int]) -> tuple[int, int]:
    """Over how many words of ``a`` and ``b``, which are equally long, an end grows, ending where agreement is best; and how many of them agree."""
    left, gain, best, more = len(a), 0, 0, 0
    for i, (word, other) in enumerate(zip(a, b), 1):
        gain += 1 if word == other else -2
        if gain > best:
            best, more = gain, i
        elif gain + left - i <= best:
            break
    return more, (best + 2 * more) // 3


def _grow_end(p: list[int], a: list[int], b: list[int], room: int) -> None:
    """Let passage ``p`` grow forward by up to ``room`` words."""
    room = max(0, min(room, len(a) - p[1], len(b) - p[3]))
    more, agree = _grown(a[p[1]:p[1] + room], b[p[3]:p[3] + room])
    p[1], p[3], p[4] = p[1] + more, p[3] + more, p[4] + agree


def align(a: np.ndarray, b: np.ndarray, xs, ys, words) -> list[tuple[int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, words that agree) of a chain over the word hashes ``a`` and ``b``.

    Passages may overlap: where fragments do not fit together, each grows into the other's place as far as words agree.
    """
    a, b = a.tolist(), b.tolist()       # most parts are too short for numpy
    passages: list[list[int]] = []
    for x, y, n in zip(xs, ys, words):
        x1, y1 = x + n, y + n
        if passages:
            p = passages[-1]
            # Let the passage before grow towards this fragment, then see whether both are one.
            _grow_end(p, a, b, min(x - p[1], y - p[3]))
            shift = max(0, p[1] - x, p[3] - y)                  # words that both claim
            if x + shift < x1:
                agree = p[4] + _gap_matches(a[p[1]:x + shift], b[p[3]:y + shift]) + (x1 - x - shift)
                if agree >= ALIKE * max(x1 - p[0], y1 - p[2]):
                    p[1], p[3], p[4] = x1, y1, agree
                    continue
            _grow_end(p, a, b, n + MARGIN)
        back = min(x, y, MARGIN + (x - passages[-1][0] if passages else 0))
        less, agree = _grown(a[x - back:x][::-1], b[y - back:y][::-1])
        passages.append([x - less, x1, y - less, y1, agree + n])
    if passages:
        _grow_end(passages[-1], a, b, MARGIN)
    return [tuple(p) for p in passages]


def _flat(column: pa.Array, kind: type, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of binary cells of ``width`` bytes a value, where each cell begins, and how many it has; a null cell is empty."""
    column = pa.concat_arrays([column.fill_null(b""), pa.array([], column.type)])
    edges = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) // width
    data = column.buffers()[2]
    values = np.frombuffer(data, kind, int(edges[-1])) if data is not None and edges[-1] else np.zeros(0, kind)
    return values, edges[:-1].astype(np.int64), np.diff(edges).astype(np.int64)


def _aligned(rows: pa.Table) -> list[np.ndarray]:
    """key, other and the passages of chains, whose two rows (side 0, then 1) share an id; a row without its other one gives nothing."""
    ids, side = rows.column("id").to_numpy(), rows.column("side").to_numpy()
    at = np.maximum.accumulate(np.where(side == 0, np.arange(len(side)), -1))
    seconds = np.flatnonzero((side == 1) & (at >= 0))
    firsts = at[seconds]
    good = ids[firsts] == ids[seconds]
    firsts, seconds = firsts[good], seconds[good]
    if not len(firsts):
        return [np.zeros(0, np.int64)] * 7
    own, other = rows.take(pa.array(firsts)).combine_chunks(), rows.take(pa.array(seconds)).combine_chunks()
    cell = lambda table, name: table.column(name).chunk(0)
    (a, a_start, a_words), (b, b_start, b_words) = _flat(cell(own, "part"), np.uint32, 4), _flat(cell(other, "part"), np.uint32, 4)
    low, other_low = cell(own, "low").to_numpy().astype(np.int64), cell(other, "low").to_numpy().astype(np.int64)
    lists = [cell(own, "xs"), cell(own, "ys"), cell(own, "words")]
    edges, (xs, ys, words) = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]), [
        v.flatten().to_pylist() for v in lists]
    out = []
    for i, (first, last, la, lb) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), low.tolist(), other_low.tolist())):
        parts = a[a_start[i]:a_start[i] + a_words[i]], b[b_start[i]:b_start[i] + b_words[i]]
        fragments = [x - la for x in xs[first:last]], [y - lb for y in ys[first:last]], words[first:last]
        out += [(i, *p) for p in align(*parts, *fragments)]
    of, start, stop, other_start, other_stop, agree = np.array(out, np.int64).reshape(-1, 6).T
    keys = [cell(own, c).to_numpy()[of] for c in ("key", "other")]
    return [*keys, start + low[of], stop + low[of], other_start + other_low[of], other_stop + other_low[of], agree]


def _words(texts: DataFrame) -> DataFrame:
    """key and the words of its text, as 4-byte hashes in a row."""
    def run(batches):
        for batch in batches:
            words = [word_hashes(t.as_py()).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words, pa.binary())], ["key", "text_words"])

    return texts.mapInArrow(run, "key long, text_words binary")


def passages(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Aligned passages of chains: key, other, start, stop, other_start, other_stop, agree."""
    span = lambda at: [
        F.greatest(F.get(at, F.lit(0)) - MARGIN, F.lit(0)).alias("low"),
        (F.element_at(at, -1) + F.element_at("words", -1) + MARGIN).alias("high")]
    named = found.withColumn("id", F.xxhash64("key", "other", F.get("xs", F.lit(0)), F.get("ys", F.lit(0))))
    # The first row of a chain carries it; the second one only brings the words of the other document.
    asked = named.select("id", F.col("key").alias("of"), F.lit(0).alias("side"), *span("xs"), "key", "other", "xs", "ys", "words").unionByName(
        named.select("id", F.col("other").alias("of"), F.lit(1).alias("side"), *span("ys")), allowMissingColumns=True)
    part = F.substring("text_words", F.col("low") * 4 + 1, (F.col("high") - F.col("low")) * 4).alias("part")
    carried = ["id", "side", "low", "key", "other", "xs", "ys", "words"]
    rows = asked.join(_words(texts).withColumnRenamed("key", "of"), "of").select(*carried, part).repartition("id").sortWithinPartitions("id", "side")
    names = ["key", "other", "start", "stop", "other_start", "other_stop", "agree"]

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [held, batch])
            starts = np.flatnonzero(now.column("side").to_numpy() == 0)
            if len(starts):         # the last chain's other row may come with the next batch
                last = now.slice(int(starts[-1]), 1).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _aligned(now)], names)
            held = last if len(starts) else None

    aligned = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return aligned.where((F.col("stop") - F.col("start") >= LEAST_PIECE) & (
        F.col("agree") >= ALIKE * F.greatest(F.col("stop") - F.col("start"), F.col("other_stop") - F.col("other_start"))))


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, several: DataFrame | None = None) -> DataFrame:
    """Passages that occur in an earlier document, within spans of at least ``least_words`` words.

    Returns key, other, start, stop, other_start, other_stop, agree, span_start, span_stop; places count words from 0, ends are exclusive.
    """
    texts = _keyed(docs, repeated_ids(docs) if several is None else several)
    linked = links(texts)
    chained = materialize(chains(linked))
    release(docs.sparkSession, linked)
    found = materialize(passages(texts, chained).distinct())
    release(docs.sparkSession, chained)
    order = Window.partitionBy("key").orderBy("start", "stop", "other", "other_start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    parts = parts.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = Window.partitionBy("key", "_span")
    return parts.withColumn("span_start", F.min("start").over(span)).withColumn("span_stop", F.max("stop").over(span)).where(
        F.col("span_stop") - F.col("span_start") >= least_words).drop("_new", "_span")


def with_ids(rows: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the doc_id in place of each of the key columns: null for documents without one."""
    own = keyed(docs.select("doc_id", "text"), repeated_ids(docs), "_key")
    hashed = materialize(own.where("not (doc_id <=> _key)").select("_key", F.col("doc_id").alias("_id"), F.lit(True).alias("_hashed")).distinct())
    for key in keys:
        rows = rows.join(hashed, rows[key] == hashed["_key"], "left").withColumn(
            key, F.when(F.col("_hashed"), F.col("_id")).otherwise(F.col(key))).drop("_key", "_id", "_hashed")
    return rows


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the repeated spans; a document that keeps no word of its own is left out.

    Columns are those of ``docs``; ``n_chars``, where there is one, follows the text. The first document of a passage keeps it.
    """
    several = repeated_ids(docs)
    key_, spans_, empty_ = unused(docs.columns, "_key", "_spans", "_empty")
    spans = materialize(repeats(docs, least_words, several).groupBy(F.col("key").alias(key_)).agg(
        F.array_sort(F.collect_set(F.struct("span_start", "span_stop"))).alias(spans_)))
    marked = keyed(docs, several, key_).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).join(
        spans, key_, "left").select(*docs.columns, spans_)
    schema = T.StructType([*docs.schema.fields, T.StructField(empty_, T.BooleanType())])
    names = docs.columns

    def run(batches):
        for batch in batches:
            columns, cut = {n: batch.column(n) for n in names}, batch.column(spans_).to_pylist()
            texts = [without(t, c) if c else t for t, c in zip(columns["text"].to_pylist(), cut)]
            empty = [bool(c) and not t.strip(" \t\n\v\f\r") for t, c in zip(texts, cut)]
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in names:
                own = columns["n_chars"]
                sizes = [len(t) if c else n for t, c, n in zip(texts, cut, own.to_pylist())]
                columns["n_chars"] = pa.array(sizes, own.type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(empty, pa.bool_())], [*names, empty_])

    return marked.mapInArrow(run, schema).where(~F.col(empty_)).drop(empty_)


def without(text: str, spans: list[dict]) -> str:
    """``text`` without the words of ``spans``, each with the white space after it."""
    import re

    starts = [m.start() for m in re.finditer(WORD, text)]
    out, done = [], 0
    for span in spans:
        first, after = span["span_start"], span["span_stop"]
        if first >= len(starts):
            break
        out.append(text[done:starts[first]])
        done = starts[after] if after < len(starts) else len(text)
    return "".join(out) + text[done:]
