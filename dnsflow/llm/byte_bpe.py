"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` and ``decode`` map Arrow batches, so nothing is shuffled and a lost task is simply run
again. Texts above ``LONG`` characters are split first, and only where no match of the pattern can
reach across, so the ids are those of the whole text; that holds for the patterns in ``SPLIT_SAFE``, with any other
texts are encoded whole. A piece that is one long run of white space
is a single match and skips the regular expression, whose stack it would overflow.

Nulls: a null text encodes like an empty one (no ids); null ids decode to no bytes. Extra columns
pass through; a column that has the name of the output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dnsflow.llm.common import with_column_type

LONG = 20_000           # characters; texts up to this length are encoded in one call
SPLIT_SAFE = frozenset([public_tokenizers.PATTERN])     # patterns no match of which reaches across ``_BOUNDARY``
ROWS = 512              # rows that a step holds at a time
IDS = T.ArrayType(T.IntegerType(), False)

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A match ends before white space that follows something else, and before the last white space of a run.
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}\\x1c-\\x1f])(?=[{_SPACE}])|(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}\\x1c-\\x1f])")
_BLANK = re.compile(f"[{_SPACE}]+")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The library's encoder, built once per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Consecutive parts of ``text`` of about ``size`` characters that may be encoded on their own.

    A part is longer only if it holds no boundary: one run of characters of the same kind.
    """
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        # A run of white space gets a part of its own, so that its length never meets the pattern.
        yield from _apart(text[start:cut.start()], size)
        start = cut.start()
    yield from _apart(text[start:], size)


def _apart(part: str, size: int) -> Iterator[str]:
    if len(part) <= 2 * size:
        yield part
        return
    at = 0
    for cut in _BOUNDARY.finditer(part):
        if cut.start() - at > size or _BLANK.fullmatch(part, at, cut.start()) and cut.start() - at > 1:
            yield part[at:cut.start()]
            at = cut.start()
    yield part[at:]


def encode_text(encoder, text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    parts = [text] if len(text) <= LONG or encoder._pat_str not in SPLIT_SAFE else pieces(text)
    ids = [
        # What is one match is encoded without the pattern.
        np.array(encoder._core_bpe.encode_single_piece(p.encode()), np.int32) if len(p) > LONG and encoder._pat_str in SPLIT_SAFE and _BLANK.fullmatch(p)
        else encoder.encode_to_numpy(p, disallowed_special=()).view(np.int32)
        for p in parts
    ]
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


#: A step takes and gives a record batch; steps that follow each other share one pass through Python.
Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def apply(df: DataFrame, added: dict[str, T.DataType], *steps: Step, dropped: Sequence[str] = ()) -> DataFrame:
    """Run ``steps`` over all batches of ``df``; they replace or add the columns ``added`` and remove ``dropped``."""
    schema = df.schema
    for name, kind in added.items():
        schema = with_column_type(schema, name, kind)
    schema = T.StructType([f for f in schema.fields if f.name not in dropped])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for step in steps:
                    part = step(part)
                yield part.select(schema.names)

    return df.mapInArrow(run, schema)


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [values], [*keep, name])


def rows_of_ids(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; none for null."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    for end in ends.tolist():
        yield flat[start:end]
        start = end


def encode_step(ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> Step:
    def step(batch):
        encoder = encoding(ranks_path, pattern)
        rows = [encode_text(encoder, t.as_py()) for t in batch.column(text)]
        offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return replaced(batch, ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))

    return step


def decode_step(ranks_path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> Step:
    def step(batch):
        encoder = encoding(ranks_path, pattern)
        decoded = [encoder.decode_bytes(i.tolist()) for i in rows_of_ids(batch.column(ids))]
        return replaced(batch, raw, pa.array(decoded, pa.binary()))

    return step


def digest_step(ids: str = "ids", digest: str = "ids_sha256") -> Step:
    """SHA-256 of the decimal ids joined by commas, in lower-case hex."""
    def step(batch):
        lists = batch.column(ids)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *lengths], dtype=np.int32)), pc.cast(lists.flatten(), pa.string()))
        joined = pc.binary_join(words, ",").cast(pa.binary())
        return replaced(batch, digest, pa.array([hashlib.sha256(j.as_py()).hexdigest() for j in joined], pa.string()))

    return step


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of ``text``."""
    return apply(df, {ids: IDS}, encode_step(ranks_path, pattern, text, ids))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """Add the bytes that ``ids`` stand for; they need not be whole characters."""
    return apply(df, {raw: T.BinaryType()}, decode_step(ranks_path, pattern, ids, raw))
