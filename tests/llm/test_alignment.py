"""Alignment of two tokenizers against the libraries on whole texts and a plain enumeration of all links."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from dnsflow.llm import alignment, queries

A, B = public_tokenizers.path(queries.BYTE_TOKENIZER), public_tokenizers.path(queries.PIECE_MODEL)
HARD = [
    None, "", " ", "  ", "a  b", "a\n b", "a \n  b c", "x▁y z", "\x00 a", "a　 b", "don't  stop 's 's", "a  b c", "日本 語  x é",
    "<|endoftext|> <s> </s> <0x41>", "a" * 3000, " \n \n ", "tab\t x ", "Ünïcödé ﬁ ①", "🙂 🙂🙂", "the the the", "the the the"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def whole_text(aligner, text):
    """Groups of one text: its ids from the libraries, cut wherever both sides have an end."""
    raw = f" {text}".encode()
    a, b = (aligner.a.encode(f" {text}", add_special_tokens=False).ids, aligner.b.encode(text)) if text else ([], [])
    if b"".join(aligner.a_bytes[i] for i in a) != raw or b"".join(aligner.b_bytes[i] for i in b) != raw:
        return []

    def by_end(ids, raws):
        at, out = 0, {}
        for i in ids:
            at += len(raws[i])
            out[at] = i
        return out

    ends_a, ends_b = by_end(a, aligner.a_bytes), by_end(b, aligner.b_bytes)
    groups, left, right = [], [], []
    for at in sorted(ends_a.keys() | ends_b.keys()):
        left += [ends_a[at]] if at in ends_a else []
        right += [ends_b[at]] if at in ends_b else []
        if at in ends_a and at in ends_b:
            groups.append((left, right))
            left, right = [], []
    return groups


def expected(aligner, texts):
    found = [whole_text(aligner, t) for t in texts]
    links = [Counter((a, b) for left, right in groups for a in left for b in right) for groups in found]
    counts = Counter(pair for own in links for pair in own)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    for groups, own in zip(found, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        yield (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
               sum(n for pair, n in own.items() if counts[pair] == best[pair[0]]), sum(n * counts[pair] for pair, n in own.items()),
               hashlib.sha256(text.encode()).hexdigest() if groups else "")


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_whole_query_against_enumeration(spark, aligner, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [t for _, t in docs] + HARD
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, pairs string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(expected(aligner, texts)))


def test_null_and_repeated_ids_and_clashing_columns(spark, aligner):
    rows = [(None, "the cat", 1), (1, "the cat", 2), (1, "the cat", 2), (1, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = alignment.document_sums(alignment.align(docs, A, B), A, B).select("key", *COLUMNS).collect()
    want = list(expected(aligner, [r[1] for r in rows]))
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.document_sums(alignment.align(docs, A, B), A, B).collect() == []


def test_correspondence_counts_documents(spark, aligner):
    texts = ["the cat sat", "the the é 日本", None, "x▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["a"], r["b"]): r["documents"] for r in alignment.correspondence(alignment.align(docs, A, B), A, B).collect()}
    assert got == Counter(p for t in texts for p in {(a, b) for x, y in whole_text(aligner, t) for a in x for b in y})


def test_large_group_is_counted_not_enumerated(aligner, monkeypatch):
    text = pa.array(["日本語" * 50 + " " + "é́̂" * 60])
    plain = [c.to_pylist() for c in alignment._documents(aligner, text)]
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert [c.to_pylist() for c in alignment._documents(aligner, text)] == plain


def test_whole_texts_where_cuts_are_not_safe(aligner):
    texts = pa.array(HARD, pa.string())
    careful = alignment.Aligner(A, B)
    careful.cuts = False
    assert aligner.cuts and [c.to_pylist() for c in alignment._documents(careful, texts)] == [
        c.to_pylist() for c in alignment._documents(aligner, texts)]


def test_long_text(spark, aligner):
    text = "word salad, " * 40_000 + "ß" * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = alignment.align(docs, A, B).first()
    assert (row["n_a"], row["n_b"]) == (len(aligner.a.encode(f" {text}", add_special_tokens=False).ids), len(aligner.b.encode(text)))


def test_identity_map_is_of_equal_bytes(aligner):
    for a, b in enumerate(aligner.identity.tolist()):
        assert b == -1 or aligner.a_bytes[a] == aligner.b_bytes[b]
