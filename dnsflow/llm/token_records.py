"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard holds records one after the other: length of the data (8 bytes, little-endian), masked checksum of those 8 bytes
(4 bytes), the data, masked checksum of the data. The checksum is CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that a checksum
over data that holds checksums stays useful. The data are ids as unsigned little-endian integers: of 16 bits where the whole
vocabulary fits, else of 32 (``RecordFiles.width``). The index is a Parquet table: shard, file, ordinal, doc_id, first (ids of the shard before the record), offset, length.

Documents are range-partitioned by doc_id: one shard per partition, the shards in order. A task writes a file of its own name and reports
it in the index, so a task that runs twice leaves at worst a file that nothing refers to.

Nulls: a null text is empty, thus one end id; a null doc_id comes first. Rows that share a doc_id stay together, in the order of their texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.operators.scale import checkpoint_folder

INDEX = "shard int, file string, ordinal long, doc_id long, first long, offset long, length long"
CACHED_WORDS = 1_000_000    # a worker remembers the ids of so many chunks of at most CACHED_LENGTH characters
CACHED_LENGTH = 40
ROWS = 2048                 # texts that are split into chunks at a time


@dataclass(frozen=True)
class RecordFiles:
    """Folders of the shards and of their index, and the bytes that an id takes."""

    shards: str
    index: str
    width: int = 4


class ChunkEncoder:
    """Ids of texts for a tokenizer that drops white space and never matches across it.

    Such a text is the sequence of its chunks between ASCII white space, and most chunks repeat: each is encoded by the library once per
    worker, in one call per batch of texts. Other white space stays inside a chunk and is the library's to drop.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True     # their strings in a text are ordinary text
        self.width = id_width(tokenizer_path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        chunks = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = chunks.flatten().dictionary_encode()
        places = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        starts = np.cumsum(sizes) - sizes
        # Where in the ids of all different chunks the ids of each chunk in the texts lie.
        lengths = sizes[places]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts[places], lengths)
        flat = np.frombuffer(b"".join(ids), f"<u{self.width}")[at]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy())])].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        ids = list(map(self.known.get, chunks))
        new = [i for i, known in enumerate(ids) if known is None]
        room = len(self.known) + len(new) <= CACHED_WORDS
        for start in range(0, len(new), 5_000):
            some = [chunks[i] for i in new[start:start + 5_000]]
            for i, chunk, encoded in zip(new[start:], some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                ids[i] = array(kind, encoded.ids).tobytes()
                if room and len(chunk) <= CACHED_LENGTH:
                    self.known[chunk] = ids[i]
        return ids


@lru_cache(maxsize=2)
def id_width(tokenizer_path: str) -> int:
    """Bytes that hold any id of the vocabulary."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_path)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def unframe(record: bytes) -> bytes:
    """The data of a record; an error if a length or checksum does not fit."""
    length, data, end = record[:8], record[12:-4], record[-4:]
    if struct.unpack("<Q", length)[0] != len(data) or struct.unpack("<I", record[8:12])[0] != masked(length) \
            or struct.unpack("<I", end)[0] != masked(data):
        raise ValueError("damaged record")
    return data


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
                  shards: int | None = None, folder: str | None = None) -> RecordFiles:
    """Encode each document, append ``end_id`` and write the records in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/dnsflow/records-{uuid.uuid4().hex}"
    files = RecordFiles(f"{folder}/shards", f"{folder}/index", id_width(tokenizer_path))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = own.repartitionByRange(*([shards] if shards else []), "doc_id").sortWithinPartitions("doc_id", "text")
    end, target, width = int(end_id).to_bytes(files.width, "little"), files.shards, files.width

    def run(batches):
        from pyarrow import fs

        encoder, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(target)
        name = f"{shard:08d}-{uuid.uuid4().hex}.records"
        out, ordinal, first, offset = None, 0, 0, 0
        parts = (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        for batch in parts:
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}")
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                record = frame(ids + end)
                out.write(record)
                rows.append((shard, name, ordinal, i, first, offset, len(record)))
                ordinal, first, offset = ordinal + 1, first + len(ids) // width + 1, offset + len(record)
            kinds = (pa.int32(), pa.string(), *[pa.int64()] * 5)
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    placed.mapInArrow(run, INDEX).write.parquet(files.index)
    return files


def read_index(spark: SparkSession, files: RecordFiles) -> DataFrame:
    """The index with ``start``, the number of ids in all records before."""
    index = spark.read.schema(INDEX).parquet(files.index)
    last = F.max_by(F.struct("first", "length"), "ordinal")
    shards = index.groupBy("shard").agg(last.alias("last")).select(
        "shard", (F.col("last.first") + (F.col("last.length") - 16) / files.width).cast("long").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)    # one row per shard
    bases = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_base"))
    return index.join(bases, index["shard"] == bases["_shard"]).withColumn(
        "start", F.col("_base") + F.col("first")).drop("_shard", "_base")


def read_records(index: DataFrame, files: RecordFiles) -> DataFrame:
    """``index`` rows, in any order and number, with the record's checked ``ids`` from the files, as 32-bit integers in bytes."""
    source, kind = files.shards, f"<u{files.width}"
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(source)
        name, opened = None, None
        for batch in batches:
            ids = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if opened is not None:
                        opened.close()
                    name, opened = file, store.open_input_file(f"{path}/{file}")
                opened.seek(offset)
                ids.append(np.frombuffer(unframe(opened.read(length)), kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"])
        if opened is not None:
            opened.close()

    return index.mapInArrow(run, schema)
