import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dnsflow.llm import token_records as t

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello world, it's 42!", None, "", "ÀÉ nbsp  wide x\x1cy", "<|endoftext|> stays text", "é́ é ́a ΑΣ ΑΣ. İ", "a b " * 5000, "x" * 3000, "\x0btab\x0cfeed\x0b ", " \n ", "a\u3000b\xa0c\x85d"]


def expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_files_hold_all_documents_in_order(spark):
    docs = spark.createDataFrame([(10 - i, x, "extra") for i, x in enumerate(TEXTS)], "doc_id long, text string, shard string")
    files = t.write_records(docs, PATH, 1, shards=3)
    index = t.read_index(spark, files)
    got = {r["doc_id"]: r for r in t.read_records(index.orderBy(F.rand(1)), files).collect()}
    start = 0
    for i, ids in sorted(zip((10 - i for i in range(len(TEXTS))), expected(TEXTS))):
        row = got[i]
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["start"] == start
        start += len(ids)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (1, "z"), (1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    files = t.write_records(docs, PATH, 1)
    rows = t.read_records(t.read_index(spark, files), files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1]
    want = [ids for ids in expected([None, "b", "a", "a", "z"])]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == want


def test_empty_table(spark):
    files = t.write_records(spark.createDataFrame([], "doc_id long, text string"), PATH, 1)
    assert t.read_records(t.read_index(spark, files), files).count() == 0


def test_damage_is_found():
    record = t.frame(b"abcdefgh")
    assert t.unframe(record) == b"abcdefgh"
    assert record[:8] == (8).to_bytes(8, "little")
    crc = zlib.crc32(b"abcdefgh")
    assert int.from_bytes(record[-4:], "little") == ((crc >> 15 | crc << 17) + 0xA282EAD8) % 2**32
    for at in (0, 9, 14, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            t.unframe(bytes(bad))


def test_chunks_beyond_the_cache_are_still_encoded(monkeypatch):
    monkeypatch.setattr(t, "CACHED_WORDS", 2)
    texts = ["one two three", "three four one", "five"]
    got = [np.frombuffer(b, "<u2").tolist() + [1] for b in t.ChunkEncoder(PATH).encode(pa.array(texts))]
    assert got == expected(texts)
