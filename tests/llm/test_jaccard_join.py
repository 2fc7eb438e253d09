import os
import random

import numpy as np
import pytest

from dnsflow.llm import jaccard_join as j
from dnsflow.llm.components import components

RULES = [j.Rule(4, 85), j.Rule(5, 80)]


def brute(texts, rule):
    """Component of each document by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        n = min(rule.words, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {i: new if v == old else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in texts}


def near_copies(seed, n=40):
    """Documents of all sizes with chains of copies around the threshold."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    while len(texts) < n:
        base = [draw.choice(words) for _ in range(draw.choice([1, 3, 4, 8, 9, 11, 14, 20, 35, 60, 150, 400]))]
        for _ in range(draw.randint(1, 5)):
            texts[len(texts)] = " ".join(base).replace("w1", draw.choice(["w1", "W1"]))
            for _ in range(draw.choice([0, 1, 1, 2, max(1, len(base) // 60)])):
                at = draw.randrange(len(base))
                base[at:at + draw.choice([0, 1, 2])] = draw.sample(words, draw.choice([0, 1])) if len(base) > 4 else base[at:at + 1]
            base = base or ["w0"]
    return texts


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, rule):
    texts = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, node string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.join(docs, rule).collect()}
    assert got == brute(texts, rule)
    kept = sorted(r["doc_id"] for r in j.keep_one(docs, rule).collect())
    assert kept == sorted({c for _, c in got.values()})


@pytest.mark.parametrize("rule", RULES)
def test_similar_sets_share_a_signature(rule):
    """The pigeonhole guarantee, for pairs at the threshold of all sizes."""
    draw = np.random.default_rng(5)
    for size in [6, 7, 8, 11, 13, 20, 33, 50, 80, 200, 700, 3000]:
        for _ in range(30):
            # A common part and differences on either side, up to the share of the union that may differ.
            union = max(size, 6)
            differ = int(draw.integers(0, (100 - rule.percent) * union // 100 + 1))
            mine = int(draw.integers(0, differ + 1))
            values = j.mix(draw.integers(0, 2**63, union, dtype=np.uint64))
            a, b = np.unique(values[:union - mine]), np.unique(np.concatenate([values[:union - differ], values[union - mine:]]))
            common = len(np.intersect1d(a, b))
            if rule.linked(common, len(a), len(b)) and min(len(a), len(b)) >= rule.first_size:
                assert np.intersect1d(j.signatures(a, rule), j.signatures(b, rule)).size


@pytest.mark.parametrize("rule", RULES)
def test_schemes_have_enough_credits(rule):
    assert rule.first_size == {85: 6, 80: 4}[rule.percent]
    for band in range(60):
        segments, near, spare = rule.scheme(band)
        largest = rule.band_start(band + 1) - 1
        differences = max(r + s - 2 * c for r in [largest] for s in range(r, rule.largest_partner(r) + 1)
                          for c in [-(-rule.percent * (r + s) // (100 + rule.percent))])
        assert segments + near - differences >= spare > 0 and near <= segments
        # A set that is similar to one in the band is in this band or the next.
        assert rule.largest_partner(largest) < rule.band_start(band + 2)


def test_words_and_shingles():
    assert len(j.word_hashes("a\x0bB\x0cc d\xa0e f\x1cg")) == 5
    assert j.word_hashes("ÄB").tolist() != j.word_hashes("äb").tolist() and j.word_hashes("aB") == j.word_hashes("Ab")
    assert len(j.shingle_set("a b c a b c a b c", 4)) == 3 and len(j.shingle_set("a b", 4)) == 1 and len(j.shingle_set(" \n", 4)) == 0


def test_nulls_repeats_and_empty_tables(spark):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(None, None), (1, None), (2, ""), (3, long), (None, long + " y"), (3, long), (9, long), (None, "alone in the world today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, j.join(docs, RULES[0]).collect()), key=str)
    assert got == sorted([(None, 0, None), (1, 0, 1), (2, 0, 2), (3, 57, 3), (3, 57, 3), (9, 57, 3), (None, 58, 3), (None, 2, None)], key=str)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in j.keep_one(docs).collect())
    assert kept == sorted([(0, ""), (1, ""), (2, ""), (3, long), (0, "alone in the world today")])
    assert j.join(docs.limit(0)).count() == 0 and j.keep_one(docs.limit(0)).count() == 0


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    one, two = (" ".join(f"{t}{i}" for i in range(60)) for t in "ab")
    rows = [(5, one), (5, two), (5, ""), (5, two), (7, one + " z"), (9, two + " z"), (2, two + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, j.keep_one(docs).collect())) == [(2, two + " y"), (5, ""), (5, one)]
    assert sorted(map(tuple, j.keep_one(docs.where("doc_id = 5")).collect())) == [(5, ""), (5, one), (5, two)]


def test_group_of_near_copies_around_one_text(spark):
    draw = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(100), 2 if i != 30 else 0):
            words[at] = f"n{i}-{at}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.join(docs, RULES[0]).collect()}
    assert got == brute(texts, RULES[0])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_passes_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f g", 1, 2, "x", 4), (2, "a b c d e f g", 5, 6, "y", 8), (3, "other words are here now", 0, 0, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _once int, _copy int, _key string, _text int")
    assert sorted(map(tuple, j.keep_one(docs).collect())) == [rows[0], rows[2]]


def test_compared_sets_are_not_written(spark, monkeypatch):
    """Near copies: what is written after the signatures stays below eight bytes a shingle, which the sets of their texts would take."""
    draw = random.Random(83)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(0, 40, 2):
        words = [draw.choice(vocabulary) for _ in range(3000)]
        texts[i], texts[i + 1] = " ".join(words), " ".join([*words[:-2], "other"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    written, materialize = [], j.materialize

    def kept(df):
        out = materialize(df)
        paths = ["/" + f.removeprefix("file:").lstrip("/") for f in out.inputFiles()]
        written.append(("sigs" in df.columns, sum(os.path.getsize(p) for p in paths)))
        return out

    monkeypatch.setattr(j, "materialize", kept)
    monkeypatch.setattr(j, "release", lambda *_: None)
    rows = j.join(docs, j.Rule(5, 80)).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in rows)
    assert sum(size for signed, size in written if not signed) < 8 * sum(r["n_shingles"] for r in rows)


def test_many_signatures_are_joined_in_passes(spark, monkeypatch):
    rule = RULES[1]
    texts = near_copies(3, 16)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shared, materialize = [], j.materialize

    def kept(df):
        if df.columns == ["sig", "node", "k"]:
            shared.append({r["sig"] for r in df.select("sig").distinct().collect()})
        return materialize(df)

    monkeypatch.setattr(j, "materialize", kept)
    monkeypatch.setattr(j, "PASS_ROWS", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.join(docs, rule).collect()}
    assert got == brute(texts, rule)
    assert len(shared) == j.PARTS and all(shared) and len(set().union(*shared)) == sum(map(len, shared))


def test_rows_that_come_more_than_once_are_compared_once(spark):
    long = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(None, long)] * 30 + [(1, long)] * 20 + [(2, long + " y")] * 10, "doc_id long, text string")
    index = j._index(docs, RULES[0])
    texts = j._texts(docs, index, index.select("node").distinct()).collect()
    assert sorted(r["text"] for r in texts) == [long, long + " y"]
    assert {r["component_id"] for r in j.join(docs, RULES[0]).collect()} == {1}
