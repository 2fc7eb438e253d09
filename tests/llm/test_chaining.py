import random

import numpy as np
import pytest

from dnsflow.llm import chaining as c
from dnsflow.llm.jaccard_join import shingle_hashes, word_hashes


def words(draw, n, tag="w"):
    return [f"{tag}{draw.randrange(10**6)}" for _ in range(n)]


def spans(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["key"], set()).add((r["span_start"], r["span_stop"]))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n_chars long")


def best_chain(fragments):
    """Score of the best chain by trying all predecessors."""
    order = sorted(fragments)
    score = []
    for i, (x, y, n) in enumerate(order):
        best = 0.0
        for j, (x0, y0, n0) in enumerate(order[:i]):
            ex, ey = x0 + n0 - c.SEED + 1, y0 + n0 - c.SEED + 1
            if ex <= x and ey <= y:
                best = max(best, score[j] - c.GAP * (x - ex + y - ey))
        score.append(n + best)
    return max(score)


def chain_score(members):
    total = 0.0
    for i, (x, y, n) in enumerate(members):
        total += n
        if i:
            x0, y0, n0 = members[i - 1]
            total -= c.GAP * (x - (x0 + n0 - c.SEED + 1) + y - (y0 + n0 - c.SEED + 1))
    return total


@pytest.mark.parametrize("seed", range(20))
def test_fenwick_chains_are_optimal(seed):
    draw = random.Random(seed)
    fragments = list({(draw.randrange(80), draw.randrange(80), draw.randint(5, 12)) for _ in range(25)})
    chains = c.chain(fragments)
    assert sorted(f for m in chains for f in m) == sorted(fragments)
    assert max(map(chain_score, chains)) == pytest.approx(best_chain(fragments))


def test_minimizers_cover_every_window():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 500, dtype=np.uint64)
    at = c.minimizers(hashes)
    for start in range(len(hashes) - c.WINDOW + 1):
        own = at[(at >= start) & (at < start + c.WINDOW)]
        assert len(own) and hashes[start:start + c.WINDOW].min() in hashes[own]
    assert c.minimizers(hashes[:0]).tolist() == [] and len(c.minimizers(hashes[:4])) == 1
    assert len(set(c.numbered(np.array([7, 7, 3, 7], np.uint64)).tolist())) == 4


def test_exact_and_fuzzy_passages_are_found_and_removed(spark):
    draw = random.Random(4)
    passage, fuzzy = words(draw, 80), words(draw, 120)
    changed = [w if i % 17 else "changed" for i, w in enumerate(fuzzy)]
    del changed[60:62]
    texts = {
        1: words(draw, 100) + passage + words(draw, 50) + fuzzy, 2: words(draw, 30) + passage + words(draw, 10),
        3: changed + words(draw, 40), 4: words(draw, 300), 5: passage[:40] + words(draw, 60), 6: passage, 7: words(draw, 5) + passage}
    docs = table(spark, {i: " ".join(t) for i, t in texts.items()})
    got = spans(c.repeats(docs))
    assert got[2] == {(30, 110)} and got[6] == {(0, 80)} and got[7] == {(5, 85)}
    (start, stop), = got[3]
    assert start <= 2 and 116 <= stop <= 119
    assert set(got) == {2, 3, 6, 7}
    kept = {r["doc_id"]: r for r in c.remove_repeats(docs).collect()}
    assert set(kept) == {1, 2, 3, 4, 5, 7}
    assert kept[2]["text"].split() == texts[2][:30] + texts[2][110:] and kept[2]["n_chars"] == len(kept[2]["text"])
    assert kept[1]["text"] == " ".join(texts[1]) and kept[1]["n_chars"] == 0


def test_passage_found_in_pieces(spark):
    draw = random.Random(8)
    a, b = words(draw, 45), words(draw, 45)
    texts = {0: words(draw, 20) + b + words(draw, 20), 1: words(draw, 9) + a + words(draw, 9), 2: words(draw, 7) + a + b + words(draw, 7)}
    assert spans(c.repeats(table(spark, {i: " ".join(t) for i, t in texts.items()}))) == {2: {(7, 97)}}


def test_texts_that_repeat_themselves(spark):
    draw = random.Random(2)
    line = words(draw, 30)
    docs = table(spark, {1: " ".join(line * 12), 2: " ".join(line * 12), 3: " ".join(words(draw, 90))})
    assert spans(c.repeats(docs)) == {2: {(0, 360)}}


def test_every_copy_of_a_passage_is_found(spark):
    draw = random.Random(3)
    passage, other = words(draw, 70), words(draw, 60)
    texts = {
        1: words(draw, 20) + passage + words(draw, 20) + other, 2: words(draw, 10) + passage + words(draw, 15) + passage + words(draw, 5) + passage,
        # Its first copies of the words stand in other places and in pieces.
        3: sum((other[i:i + 8] + words(draw, 9) for i in range(0, 60, 4)), []) + other}
    docs = table(spark, {i: " ".join(t) for i, t in texts.items()})
    got = spans(c.repeats(docs))
    assert got[2] == {(10, 80), (95, 165), (170, 240)}
    assert max(got[3])[0] <= len(texts[3]) - 60 and max(got[3])[1] == len(texts[3])
    kept = {r["doc_id"]: r["text"].split() for r in c.remove_repeats(docs).collect()}
    assert kept[1] == texts[1] and kept[2] == texts[2][:10] + texts[2][80:95] + texts[2][165:170]


def test_a_passage_of_frequent_lines_is_found(spark):
    draw = random.Random(12)
    lines = [words(draw, 12) for _ in range(12)]
    texts = {i: sum((line + words(draw, 6) * draw.randrange(2) for line in draw.sample(lines, 4)), []) for i in range(300)}
    shared = sum(draw.sample(lines, 7), [])
    for i in (200, 290):
        texts[i] = words(draw, 20) + shared + words(draw, 20)
    found = c.repeats(table(spark, {i: " ".join(t) for i, t in texts.items()})).where("key = 290 and other = 200")
    assert [(r["start"], r["stop"]) for r in found.collect()] == [(20, 104)]


def test_alignment_counts_agreeing_words():
    a = word_hashes(" ".join(f"w{i}" for i in range(100)))
    b = np.concatenate([a[:50], word_hashes("x"), a[52:]])
    (start, stop, other, other_stop, agree), = c.align(a, b, [0, 52], [0, 51], [50, 48])
    assert (start, stop, other, other_stop, agree) == (0, 100, 0, 99, 98)
    assert c._gap_matches(a[:5], a[1:6]) == 4
    assert len(shingle_hashes(a, c.SEED)) == 96


def test_nulls_repeats_and_empty_tables(spark):
    draw = random.Random(6)
    text = " ".join(words(draw, 70))
    rows = [(None, None, 0), (1, "", 0), (2, text, 0), (2, text, 0), (None, "before " + text, 0), (3, "short", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = c.with_ids(c.repeats(docs), docs, "key", "other").collect()
    assert len(found) == 1 and {found[0]["key"], found[0]["other"]} == {None, 2}
    # The later of the two by key gives the passage up; a text of nothing else goes.
    assert c.remove_repeats(docs).count() == (6 if found[0]["key"] is None else 4)
    assert c.repeats(docs.limit(0)).count() == 0 and c.remove_repeats(docs.limit(0)).count() == 0


def test_removal_keeps_other_white_space():
    assert c.without("a  b\tc d\n e", [{"span_start": 1, "span_stop": 3}]) == "a  d\n e"
    assert c.without(" a b ", [{"span_start": 0, "span_stop": 2}]) == " "


def test_rows_with_one_id_and_several_texts_are_documents_of_their_own(spark):
    draw = random.Random(41)
    passage, own = words(draw, 90), words(draw, 200)
    first, second = " ".join(passage + words(draw, 60)), " ".join(passage + words(draw, 70))
    clean = " ".join(own)
    for other in (clean, None, "", "short"):
        for rows in ([(1, first), (2, second), (2, other)], [(2, other), (2, second), (1, first)], [(1, first), (2, other), (2, second)]):
            docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
            kept = sorted(((r["doc_id"], r["text"]) for r in c.remove_repeats(docs).collect()), key=str)
            cut = [k for k in kept if k not in ((1, first), (2, second), (2, other))]
            # Of the passage one copy goes; which of the two documents is first may depend on their texts, as an id with two texts orders by hash.
            assert len(kept) == 3 and (2, other) in kept and len(cut) == 1
            assert not set(passage[5:85]) & set(cut[0][1].split())


def test_columns_with_clashing_names_pass(spark):
    draw = random.Random(43)
    passage = words(draw, 80)
    texts = [" ".join(words(draw, 30) + passage + words(draw, 30)) for _ in range(2)]
    rows = [(i, t, "a", i * 10, True, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _key int, _empty boolean, _several string")
    kept = {r["doc_id"]: r for r in c.remove_repeats(docs).collect()}
    assert kept[0]["text"] == texts[0] and len(kept[1]["text"].split()) == 60
    assert [tuple(kept[i])[2:] for i in (0, 1)] == [r[2:] for r in rows]


def test_exact_repeats_against_brute_force(spark):
    """Every place of a 50-word run that an earlier document holds lies in a span."""
    draw = random.Random(47)
    pool = [words(draw, 55 + 10 * i) for i in range(6)]
    texts = {}
    for i in range(40):
        parts = [words(draw, draw.randrange(5, 60))]
        for _ in range(draw.randrange(3)):
            parts += [draw.choice(pool), words(draw, draw.randrange(5, 60))]
        texts[i] = [w for p in parts for w in p]
    seen, wanted = set(), set()
    for i, text in texts.items():
        runs = {j: tuple(text[j:j + 50]) for j in range(len(text) - 49)}
        wanted |= {(i, j + k) for j, run in runs.items() if run in seen for k in range(50)}
        seen |= set(runs.values())
    rows = c.repeats(table(spark, {i: " ".join(t) for i, t in texts.items()})).select("key", "span_start", "span_stop").distinct().collect()
    found = {(r[0], j) for r in rows for j in range(r[1], r[2])}
    assert wanted and wanted <= found
    pooled = {w for p in pool for w in p}
    # Nothing far outside of the planted passages is touched.
    assert sum(texts[i][j] not in pooled for i, j in found) <= 0.02 * len(found)


def test_texts_go_to_python_once_however_many_chains_ask(spark, capsys):
    texts = spark.createDataFrame([], "key long, text string")
    found = spark.createDataFrame([], "key long, other long, xs array<int>, ys array<int>, words array<int>")
    c.passages(texts, found).explain()
    steps = [line.split("MapInArrow")[1].split(")#")[0] for line in capsys.readouterr().out.splitlines() if "MapInArrow" in line]
    assert [step.count("#") for step in steps if "text#" in step] == [2]        # key and text, and no parts that chains ask for


@pytest.mark.parametrize("seed", range(5))
def test_quick_forms_equal_plain_ones(seed):
    draw = np.random.default_rng(seed)
    for _ in range(200):
        hashes = draw.integers(0, draw.choice([3, 30, 2**62]), draw.integers(11, 60)).astype(np.uint64)
        runs = [hashes[i:i + c.WINDOW].argmin() + i for i in range(len(hashes) - c.WINDOW + 1)]
        assert c.minimizers(hashes).tolist() == sorted(set(map(int, runs)))
        a, b = (draw.integers(0, 5, draw.integers(1, 25)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1)]
        for word in a:
            row = [0]
            for j, other in enumerate(b):
                row.append(best[-1][j] + 1 if word == other else max(row[j], best[-1][j + 1]))
            best.append(row)
        assert c._gap_matches(a, b) == best[-1][-1]
        size = draw.integers(0, 30)
        x, y = (draw.integers(0, 2, size).tolist() for _ in range(2))
        gains = [sum(1 if p == q else -2 for p, q in zip(x[:i], y[:i])) for i in range(size + 1)]
        more = gains.index(max(gains))
        assert c._grown(x, y) == (more, sum(p == q for p, q in zip(x[:more], y[:more])))
        pair = list({(int(draw.integers(40)), int(draw.integers(40)), int(draw.integers(5, 30))) for _ in range(2)})
        if len(pair) == 2:
            assert max(map(chain_score, c.chain(pair))) == pytest.approx(best_chain(pair))
