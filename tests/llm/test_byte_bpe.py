import hashlib
import random

import public_tokenizers
import pytest

from dnsflow.llm import byte_bpe as b

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
HARD = ["", "a", "it's 12 o'clock\n\n  now ", "zażółć gęślą 日本語 🙂   x", "  lead", "tail  ", "'ll 'LL", "<|endoftext|>", "a\x1cb\x85c"]


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_ids_and_bytes_match_the_library(spark):
    encoder = b.encoding(PATH, PATTERN)
    texts = [None, *HARD, "mixed words, 42 times " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    done = rows(b.decode(b.encode(docs, PATH, PATTERN), PATH, PATTERN), "ids", "raw")
    for i, t in enumerate(texts):
        want = encoder.encode_ordinary(t or "")
        assert done[i][0] == want and bytes(done[i][1]) == (t or "").encode()


def test_pieces_of_long_texts_encode_like_the_whole():
    encoder = b.encoding(PATH, PATTERN)
    draw = random.Random(3)
    alphabet = ["word", "Ünï", " ", "  ", "\n", "\t\n ", "'s", "'", "9", "!?", "　", "\x1c", "…"]
    for _ in range(200):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(1, 120)))
        for size in (3, 10, 40):
            parts = list(b.pieces(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "a" * 300_000, "\n" * 500_000, "ab " * 100_000])
def test_very_long_runs(text):
    encoder = b.encoding(PATH, PATTERN)
    ids = b.encode_text(encoder, text)
    assert encoder.decode_bytes(ids.tolist()) == text.encode()


def test_digest_step_and_empty_table(spark):
    from pyspark.sql import types as T

    docs = spark.createDataFrame([(1, [3, 20, 5]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = rows(b.apply(docs, {"d": T.StringType()}, b.digest_step("ids", "d")), "d")
    digest = lambda s: hashlib.sha256(s).hexdigest()
    assert got == {1: (digest(b"3,20,5"),), 2: (digest(b""),), 3: (digest(b""),)}
    assert b.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_other_patterns_encode_whole_long_texts():
    import numpy as np
    import public_tokenizers

    from dnsflow.llm import byte_bpe

    pattern = r" ?\p{L}+| ?[^\s\p{L}]+[\r\n]*|\s+"      # punctuation takes the line ends after it
    encoder = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern)
    text = "ab.\n" * 12_000
    assert np.array_equal(byte_bpe.encode_text(encoder, text), encoder.encode_ordinary(text))
    safe = byte_bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert np.array_equal(byte_bpe.encode_text(safe, text), safe.encode_ordinary(text))
