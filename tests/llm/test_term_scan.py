"""Lexical search against a plain computation with regular expressions and Python integers."""

import math
import re
from collections import Counter

import pytest

from dnsflow.llm import term_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, top):
    counted = [(key, Counter(terms(text))) for key, text in docs]
    holding = [own for _, own in counted if own]
    number, total = len(holding), sum(sum(own.values()) for own in holding)
    df = Counter(t for own in holding for t in own)
    out = []
    for item_id, text in items:
        scores = []
        for key, own in counted:
            n = sum(own.values())
            score = 0
            for t in set(terms(text)) & own.keys():
                m = 100 - 50 + (50 * n * number) // total
                score += math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * own[t]) // (1000 * own[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item_id, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat. The CAT sat!"), (2, "cat_dog cat-dog"), (3, None), (4, ""), (5, " ,;\t"), (6, "Straße ÄÖ äö 日本 cat"),
    (None, "the cat"), (None, "the cat"), (7, "the cat"), (7, "the cat"), (7, "dogs only"), (8, "x\x00cat\x7fcat{cat}"), (9, "a b c d e f the " * 700)]
ITEMS = [(0, "The cat"), (1, "dog dog DOG"), (2, None), (3, ""), (4, "äö ÄÖ 日本 straße"), (4, "cat"), (None, "sat"), (5, "nowhere"), (6, "e f a")]


def frames(spark, items, docs):
    return (spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, rank int"),
            spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(3))


@pytest.mark.parametrize("top", [2, 50])
def test_against_plain_computation(spark, top):
    items, docs = frames(spark, ITEMS, DOCS)
    got = term_scan.search(items, docs, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(ITEMS, DOCS, top)


def test_items_in_blocks_and_small_batches(spark, monkeypatch):
    items, docs = frames(spark, ITEMS, DOCS)
    monkeypatch.setattr(term_scan, "ITEM_BYTES", 8)
    monkeypatch.setattr(term_scan, "CELLS", 3)
    assert sorted(map(tuple, term_scan.search(items, docs, top=2).collect()), key=str) == plain(ITEMS, DOCS, 2)


def test_many_documents_keep_the_best_of_a_task(spark):
    docs = [(i, " ".join(["word", *["pad"] * (i * 7919 % 101), *["word"] * (i * 31 % 5)])) for i in range(3000)]
    items, table = frames(spark, [(0, "word"), (1, "pad word")], docs)
    assert sorted(map(tuple, term_scan.search(items, table, top=5).collect()), key=str) == plain([(0, "word"), (1, "pad word")], docs, 5)


def test_empty_tables(spark):
    items, docs = frames(spark, ITEMS, DOCS)
    assert term_scan.search(items, docs.limit(0)).collect() == []
    assert term_scan.search(items.limit(0), docs).collect() == []


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x500))) + " aB9_z é-É 日本\U0001F600"
    assert [t.decode() for t in term_scan.read(text).split()] == terms(text)
